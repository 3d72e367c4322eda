import datetime
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import millrace as mr
from millrace.functions import automaton, numbering
from millrace.functions.ratio import lcs_length, ratio, token_sort_ratio
from millrace.operators import language, neighbours, pii, textprep
from millrace.operators.impute import impute_knn, neighbour_means


def column(df, c, by=None):
    return [r[c] for r in (df.orderBy(by) if by else df).collect()]


def test_disguised_missing(spark):
    df = spark.createDataFrame([(" N/A ", 999), ("??", 5), ("fine ", -1), ("", 7), (None, None), ("Nope", 1)], "s string, n long")
    out = mr.replace_disguised_missing(df, ["nope"], [999, -1])
    assert column(out, "s") == [None, None, "fine ", None, None, None] and column(out, "n") == [None, 5, None, 7, None, 1]


def test_simple_imputation(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 3.0, None), (None, 5.0, "b")], "i int, x double, s string")
    mean = mr.impute_missing(df, "mean")
    assert column(mean, "x") == [1.0, 3.0, 3.0, 5.0] and column(mean, "s") == ["a", "b", "b", "b"] and column(mean, "i") == [1.0, 2.0, 3.0, 2.0]
    assert column(mr.impute_missing(df, "constant", "constant", constant_value=2.5), "i") == [1.0, 2.0, 3.0, 2.5]
    with pytest.raises(ValueError):
        mr.impute_missing(df, "other")
    empty = spark.createDataFrame([(None,)], "x double")
    assert column(mr.impute_missing(empty, "median"), "x") == [None]


@pytest.mark.parametrize("parts", [1, 7])
def test_ordered_imputation_does_not_depend_on_partitions(spark, parts):
    rows = [(1, "a", None), (2, "a", 2.0), (3, "a", None), (4, "a", None), (5, "a", 8.0), (6, "a", None), (7, "b", None)]
    df = spark.createDataFrame(rows, "id int, g string, x double").repartition(parts)
    fill = lambda how: column(mr.impute_missing(df, how, columns=["x"], order_by="id", partition_by="g"), "x", "id")
    assert fill("ffill") == [None, 2.0, 2.0, 2.0, 8.0, 8.0, None]
    assert fill("bfill") == [2.0, 2.0, 8.0, 8.0, 8.0, None, None]
    assert fill("interpolate") == [None, 2.0, 4.0, 6.0, 8.0, None, None]


def test_fills_carry_over_the_ranges_of_a_hot_key(spark):
    rng = np.random.default_rng(1)
    n = 600
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n)).astype(object)
    key[rng.random(n) < 0.05] = None
    value = np.where(rng.random(n) < 0.9, np.nan, np.round(rng.normal(size=n), 3))
    word = np.where(rng.random(n) < 0.9, None, rng.choice(["x", "y"], n))
    rows = [(int(i), k, None if np.isnan(v) else float(v), w, 7) for i, k, v, w in zip(rng.permutation(n), key, value, word)]
    df = spark.createDataFrame(rows, "`id.x` int, range string, at double, x0 string, row int")  # names the step uses itself
    pdf = pd.DataFrame(rows, columns=["id", "key", "value", "word", "row"]).sort_values("id")

    def expected(c, how, keyed):
        parts = [pdf[c]] if not keyed else [g[c] for _, g in pdf.groupby("key", dropna=False)]
        fill = lambda x: x.astype(float).reset_index(drop=True).interpolate(limit_area="inside").to_numpy() if how == "interpolate" else getattr(x, how)().to_numpy()
        got = pd.concat([pd.Series(fill(x), x.index, dtype=object) for x in parts]).sort_index()
        ids = pdf["id"].sort_index()
        return {i: None if pd.isna(v) else v for i, v in zip(ids, got)}

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges even on a small table
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        for how in ("ffill", "bfill", "interpolate"):
            for keyed in (True, False):
                texts = "bfill" if how == "interpolate" else how
                out = mr.impute_missing(df, how, texts, columns=["at", "x0"], order_by="id.x", partition_by="range" if keyed else None)
                assert out.columns == df.columns
                found = out.collect()
                numbers, words = expected("value", how, keyed), expected("word", texts, keyed)
                assert len(found) == n and all(r[3] == words[r[0]] and r[4] == 7 for r in found)
                assert all((r[2] is None) == (numbers[r[0]] is None) and (r[2] is None or abs(r[2] - numbers[r[0]]) < 1e-9) for r in found)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    x[rng.random((60, 3)) < 0.2] = np.nan
    x[0] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id int, a double, b double, c double")
    got = np.array([[r.a, r.b, r.c] for r in mr.impute_missing(df, "knn", columns=["a", "b", "c"]).orderBy("id").collect()])
    pool = x[np.lexsort(x.T[::-1])]
    means = np.nanmean(x, axis=0)
    for i, row in enumerate(x):
        for j in range(3):
            if not np.isnan(row[j]):
                assert got[i, j] == row[j]
                continue
            ranked = []
            for k, d in enumerate(pool):
                both = ~np.isnan(d) & ~np.isnan(row)
                if not np.isnan(d[j]) and both.any():
                    ranked.append((3 / both.sum() * ((d - row)[both] ** 2).sum(), k, d[j]))
            near = [v for _, _, v in sorted(ranked)[:5]]
            assert got[i, j] == pytest.approx(np.mean(near) if near else means[j])
    assert neighbour_means(np.array([[np.nan]]), np.array([[2.0]]), np.array([7.0]), 5)[0, 0] == 7.0


def test_knn_counts_repeated_rows_and_uses_every_donor(spark, monkeypatch):
    """Half the rows are equal; blocks and groups are small; the nearest five are rows, not distinct rows."""
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    monkeypatch.setattr(neighbours, "GROUP", 3)
    rows = [(1.0, 10.0)] * 40 + [(float(k), float(100 * k)) for k in range(2, 30)] + [(1.1, None)] * 30 + [(k + 0.4, None) for k in range(2, 29)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a double, b double").repartition(4)
    got = {r.id: r.b for r in impute_knn(df, ["a", "b"]).collect()}
    for i, (a, b) in enumerate(rows):
        near = sorted((2 * (a - x) ** 2, x, y) for x, y in rows if y is not None)[:5]
        assert got[i] == pytest.approx(b if b is not None else np.mean([y for _, _, y in near])), i


@pytest.mark.parametrize("table, columns, key", [("part", ["p_retailprice", "p_size"], "p_partkey"), ("lineitem", ["l_quantity", "l_extendedprice", "l_discount"], "l_orderkey")])
def test_knn_visits_few_of_all_pairs(spark, table, columns, key):
    """The same answers as over all pairs, with less than a tenth of their distances."""
    df = spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet").select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    lost = F.pmod(F.xxhash64(*columns), F.lit(40))
    df = df.withColumns({c: F.when(lost != i, F.col(c)) for i, c in enumerate(columns[-2:])})
    report = {}
    got = impute_knn(df, columns, report=report)
    print("visited", table, report)
    assert 0 < report["compared"] < report["pairs"] / 10
    rows = df.select(columns).toPandas().to_numpy(float)
    donors = rows[np.lexsort(rows.T[::-1])]
    wanted = rows[np.isnan(rows).any(axis=1)][:200]
    full = neighbour_means(wanted, donors, np.nanmean(rows, axis=0), 5)
    filled = got.select(columns).toPandas().to_numpy(float)
    known = {tuple(r) for r in np.round(filled, 6)}
    assert all(tuple(r) in known for r in np.round(full, 6))


def test_cell_bounds_never_exceed_distances():
    rng = np.random.default_rng(8)
    for _ in range(200):
        y, x = rng.integers(-3, 4, (30, 4)).astype(float), rng.integers(-3, 4, 4).astype(float)
        y[rng.random(y.shape) < 0.3] = np.nan
        x[rng.random(4) < 0.3] = np.nan
        with np.errstate(all="ignore"):
            box = neighbours.Cells([0], np.nanmin(y, axis=0)[None], np.nanmax(y, axis=0)[None], (~np.isnan(y)).sum(axis=0)[None].astype(float), np.array([30.0]), [(0, 1, 2, 3)])
        assert box.bounds(x)[0] <= neighbours.distances(x[None], y).min()


def test_mice_equals_a_plain_version(spark):
    """Bayesian ridge over rows, by iterated linear systems, in numpy: the same fills to 1e-6."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(120, 4)) @ rng.normal(size=(4, 4)) + [5, -3, 0, 100]
    x[rng.random(x.shape) < 0.15] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    got = np.array([[r.a, r.b, r.c, r.d] for r in mr.impute_missing(df, "mice", columns=["a", "b", "c", "d"]).orderBy("id").collect()])

    def ridge(z, y):
        zc, yc = z - z.mean(axis=0), y - y.mean()
        alpha, lam, old = 1 / (yc.var() + np.finfo(float).eps), 1.0, None
        for _ in range(300):
            cov = np.linalg.inv(lam * np.eye(z.shape[1]) + alpha * zc.T @ zc)
            w = alpha * cov @ zc.T @ yc
            gamma = z.shape[1] - lam * np.trace(cov)
            lam = (gamma + 2e-6) / (w @ w + 2e-6)
            alpha = (len(y) - gamma + 2e-6) / (((yc - zc @ w) ** 2).sum() + 2e-6)
            if old is not None and np.abs(old - w).sum() < 1e-3:
                break
            old = w
        w = alpha * np.linalg.inv(lam * np.eye(z.shape[1]) + alpha * zc.T @ zc) @ zc.T @ yc
        return y.mean() - w @ z.mean(axis=0), w

    lost = np.isnan(x)
    full = np.where(lost, np.nanmean(x, axis=0), x)
    order, seen = sorted(range(4), key=lambda j: lost[:, j].sum()), {}
    for _ in range(10):
        moved = 0.0
        for j in order:
            others = [k for k in range(4) if k != j]
            constant, w = ridge(full[~lost[:, j]][:, others], full[~lost[:, j], j])
            full[lost[:, j], j] = constant + full[lost[:, j]][:, others] @ w
            now = np.append(w, constant)
            moved = max(moved, np.max(np.abs(now - seen[j]) / (1e-9 + np.abs(now).max())) if j in seen else np.inf)
            seen[j] = now
        if moved < 1e-3:
            break
    np.testing.assert_allclose(got, full, rtol=1e-6, atol=1e-6)


def test_mice_recovers_a_linear_relation(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), None if i % 4 == 0 else float(3 * a - 2 * b + 1), None if i % 5 == 0 else float(b)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "id int, a double, y double, b double")
    out = mr.impute_missing(df, "mice", columns=["a", "y", "b"])
    both = {r.id: r for r in out.collect()}
    for i, a, y, b in rows:
        if y is None and b is not None:
            assert both[i].y == pytest.approx(3 * a - 2 * b + 1, abs=0.05)


def test_dates_and_booleans(spark):
    df = spark.createDataFrame([("2024-01-05", "03/02/2024", "Jan 5 2024 10:30", " YES", "t"), ("2023-12-31", "31/12/2023", "6 Feb 2021", "off", "x"), ("bad", None, None, None, None)], "a string, b string, c string, d string, e string")
    out = mr.parse_dates(df, ["a", "b", "c"], 0.6)
    assert dict(out.dtypes) == {"a": "date", "b": "date", "c": "timestamp_ntz", "d": "string", "e": "string"}
    assert column(out, "b")[1] == datetime.date(2023, 12, 31) and column(out, "c")[0] == datetime.datetime(2024, 1, 5, 10, 30)
    parts = mr.extract_date_parts(out, ["a"]).first()
    assert (parts.a_year, parts.a_month, parts.a_day, parts.a_weekday, parts.a_quarter) == (2024, 1, 5, 5, 1)
    flags = mr.normalize_booleans(df)
    assert column(flags, "d") == [True, False, None] and dict(flags.dtypes)["e"] == "string"


def test_downcast(spark):
    df = spark.createDataFrame([(1, 300, 2**40, 1.5), (-128, 0, 1, None)], "a long, b long, c long, d double")
    assert dict(mr.downcast_numeric(df).dtypes) == {"a": "tinyint", "b": "smallint", "c": "bigint", "d": "float"}


def test_clusters_follow_the_greedy_rule(spark):
    rng = np.random.default_rng(3)
    words = ["north gate", "south gate", "river bank", "Gate North", "old mill", ""]
    values = []
    for _ in range(150):
        w = list(words[rng.integers(len(words))])
        for _ in range(rng.integers(0, 3)):
            if w:
                w[rng.integers(len(w))] = "abcdef "[rng.integers(7)]
        values += ["".join(w)] * int(rng.integers(1, 4))
    counts = sorted(pd.Series(values).value_counts().items(), key=lambda x: (-x[1], x[0]))
    for threshold in (80, 90, 100):
        canonical, table = [], {}
        for v, _ in counts:
            near = next((k for k in canonical if token_sort_ratio(v.lower(), k.lower()) >= threshold), None)
            canonical += [v] if near is None else []
            table[v] = v if near is None else near
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "id int, c string")
        got = mr.fuzzy_cluster_categories(df, threshold=threshold).orderBy("id").collect()
        assert [r.c for r in got] == [None, *[table[v] for v in values]]
    assert mr.fuzzy_cluster_categories(df.limit(0)).count() == 0


def test_categories(spark):
    df = spark.createDataFrame([("New York",)] * 5 + [("newyork",)] * 2 + [("Paris",), (None,)], "c string")
    assert sorted(map(str, column(mr.fuzzy_cluster_categories(df), "c"))) == ["New York"] * 7 + ["None", "Paris"]
    assert column(mr.group_rare_categories(df, 0.2), "c").count("Other") == 1
    label = mr.encode_categorical(df, "label")
    assert sorted(column(label, "c"), key=str) == [0] * 5 + [1, 1, 2, None]
    assert sorted(column(mr.encode_categorical(df, "frequency"), "c")) == [1, 1, 2, 2, 5, 5, 5, 5, 5]
    assert "c_null" in mr.encode_categorical(df).columns
    for bad in ("target", "other"):
        with pytest.raises(ValueError):
            mr.encode_categorical(df, bad)
    many = {f"k{i}": f"v{i}" for i in range(300)}
    assert column(mr.replace_values(spark.createDataFrame([("k7",), ("x",)], "c string"), {"c": many}), "c") == ["v7", "x"]
    assert mr.correct_categorical_values(lambda c, v: "- A\n- B", "c", ["a", "b"]) == ["A", "B"]
    assert mr.correct_categorical_values(lambda c, v: "A", "c", ["a", "b"]) == ["a", "b"]
    fixed = mr.fix_spelling_errors_in_categorical(spark.createDataFrame([(f"x{k}",) for k in range(25)], "c string"), corrector=lambda c, v: [x.upper() for x in v], batch=10)
    assert sorted(column(fixed, "c")) == sorted(f"X{k}" for k in range(25))


def test_ratio():
    rnd = random.Random(0)

    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(200):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        assert lcs_length(a, b) == slow(a, b)
    assert ratio("", "") == 100 and token_sort_ratio("b a", "a b") == 100 and round(ratio("new york", "newyork"), 1) == 93.3


@pytest.mark.parametrize("keep", ["first", "last"])
def test_fuzzy_dedup_is_the_greedy_rule(spark, keep):
    rnd = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    texts = []
    for i in range(120):
        t = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 4)))
        for _ in range(rnd.randint(0, 2)):
            if t:
                k = rnd.randrange(len(t))
                t = t[:k] + rnd.choice("abx") + t[k + 1 :]
        texts.append(t)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(5)
    kept, order = [], range(120) if keep == "first" else range(119, -1, -1)
    for i in order:
        if not any(token_sort_ratio(texts[i].lower().strip(), texts[k].lower().strip()) >= 85 for k in kept):
            kept.append(i)
    assert sorted(column(mr.fuzzy_deduplicate(df, ["t"], 85, keep, "id"), "id")) == sorted(kept)
    if keep == "first":
        flags = {r.id: r.t_near_dup for r in mr.near_duplicate_text(df, "t", 85, order_by="id").collect()}
        assert all(flags[i] == (i not in kept) for i in range(120) if texts[i].strip())
        assert not any(flags[i] for i in range(120) if not texts[i].strip())


def test_exact_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "k int, s string")
    assert mr.handle_duplicates(df).count() == 3 and mr.duplicate_count(df) == 4
    assert column(mr.drop_duplicates_subset(df, ["k"], "none"), "k") == [3]
    assert mr.drop_duplicates_subset(df, ["k"], "any").count() == 3
    with pytest.raises(ValueError):
        mr.drop_duplicates_subset(df, ["k"], "some")


def test_validation(spark):
    df = spark.createDataFrame([(5, "a@b.co"), (200, "x"), (None, None)], "age int, mail string")
    assert column(mr.apply_range_rules(df, {"age": (0, 120)}), "age") == [5, None, None]
    assert column(mr.apply_range_rules(df, {"age": (0, 120)}, "clip"), "age") == [5, 120, None]
    assert column(mr.apply_range_rules(df, {"age": (0, 120)}, "drop"), "age") == [5, None]
    assert column(mr.validate_formats(df, {"mail": "email", "age": "nothing"}), "mail_valid") == [True, False, None]
    out, report = mr.check_cross_field(df, {"small": F.col("age") < 100, "mail": "mail <> 'a@b.co'"}, True)
    assert report == {"small": 1, "mail": 1} and out.count() == 1
    assert mr.check_referential_integrity(df, "age", [5], True)[0].count() == 2
    kept, bad = mr.check_referential_integrity(df, "age", spark.createDataFrame([(5,), (5,)], "k int"), True)
    assert bad == 1 and kept.count() == 2


def test_domains(spark):
    df = spark.createDataFrame([("(415) 555-2671", " U.S.A. ", "HTTP://Example.com/a/?q=1#x"), ("123", "Narnia", " "), (None, None, None)], "p string, c string, u string")
    assert column(mr.normalize_phone_numbers(df, ["p"]), "p") == ["+14155552671", None, None]
    assert column(mr.standardize_country_region(df, ["c"]), "c") == ["United States", "narnia", None]
    assert column(mr.standardize_country_region(df, ["c"], keep_unmapped_case=True), "c")[1] == "Narnia"
    once = mr.canonicalize_urls(df, ["u"])
    assert column(once, "u") == ["http://example.com/a?q=1", None, None]
    assert column(mr.canonicalize_urls(once, ["u"]), "u") == column(once, "u")
    assert column(mr.convert_currency(spark.createDataFrame([("10",), ("x",)], "v string"), ["v"], {"v": 0.5}), "v") == [5.0, None]
    mails = mr.normalize_emails(spark.createDataFrame([(" A@B.co ",), ("no",), (None,)], "m string"), ["m"])
    assert [tuple(r) for r in mails.collect()] == [("a@b.co", True), ("no", False), (None, None)]


def test_phones_of_many_regions(spark):
    cases = [
        ("US", "(415) 555-2671", "+14155552671"), ("US", "1-415-555-2671 x9", "+14155552671"), ("US", "011 44 20 7946 0958", "+442079460958"), ("US", "115 555 2671", None), ("GB", "020 7946 0958", "+442079460958"),
        ("GB", "+44 (0) 20", None), ("DE", "030 901820", "+4930901820"), ("DE", "0049 30 901820", "+4930901820"), ("DE", "4930901820", "+494930901820"), ("FR", "01 42 68 53 00", "+33142685300"), ("JP", "03-3224-5000", "+81332245000"),
        ("AU", "(02) 9374 4000", "+61293744000"), ("IT", "06 698 12345", "+390669812345"), ("RU", "8 (495) 606-36-02", "+74956063602"), ("HU", "06 1 441 4000", "+3614414000"), ("CH", "044 668 18 00", "+41446681800"),
        ("BR", "(11) 2395-8400", "+551123958400"), ("IN", "080-6721 8000", "+918067218000"), ("SG", "6521 8000", "+6565218000"), ("AE", "04 450 9500", "+97144509500"), ("ES", "915 55 12 34", "+34915551234"),
        ("IS", "+354 545 9960", "+3545459960"), ("US", "+999 12345678", None), ("US", "", None), ("US", None, None), ("US", "call me", None), ("NZ", "+64 9 887 6986", "+6498876986"), ("US", "+81 3 3224 5000", "+81332245000"),
    ]
    for region in {r for r, _, _ in cases}:
        own = [(p, e) for r, p, e in cases if r == region]
        got = mr.normalize_phone_numbers(spark.createDataFrame(own, "p string, e string"), ["p"], region).collect()
        assert [(r.p, r.e) for r in got] == [(e, e) for _, e in own], region
    assert len(numbering.regions()) > 200 and not any(a != b and b.startswith(a) for a in numbering.codes() for b in numbering.codes())
    with pytest.raises(ValueError, match="region"):
        mr.normalize_phone_numbers(spark.createDataFrame([("1",)], "p string"), ["p"], "XX")


def test_language_profiles(spark):
    """Profiles learnt from two thirds of the documents tell the others' languages; learning equals a plain count."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learn, held = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0 AND lang IS NOT NULL")
    profiles = mr.learn_profiles(learn, "text", "lang")
    found = mr.detect_language(held, "text", "guess", profiles, "far").select("lang", "guess", "far", "text").collect()
    assert np.mean([r.lang == r.guess for r in found]) > 0.95
    words = Counter(w for r in learn.where("lang = 'de'").collect() for w in re.findall(r"[^\W\d_]+", (r.text or "").lower()))
    plain = language.ranking(words)
    assert {r.gram: r["rank"] for r in profiles.where("lang = 'de'").collect()} == plain
    one = next(r for r in found if r.guess == "de")
    assert one.far == language.out_of_place(language.ranking(Counter(re.findall(r"[^\W\d_]+", one.text.lower()))), plain)
    assert mr.detect_language(docs.limit(0), "text").count() == 0
    assert [r.t_lang for r in mr.detect_language(spark.createDataFrame([("some text",)], "t string"), "t", profiles={}).collect()] == [None]


def test_shipped_languages(spark):
    sentences = {
        "en": "Where did you put my keys?", "de": "Morgen wird das Wetter schön und wir gehen an den Strand.", "fr": "Demain il fera beau et nous irons à la plage.", "es": "Mañana hará buen tiempo y vamos a la playa.",
        "it": "Domani farà bel tempo e andremo in spiaggia.", "pt": "Amanhã o tempo vai estar bom e vamos à praia.", "nl": "Morgen wordt het mooi weer en gaan we naar het strand.", "fi": "Huomenna on kaunis sää ja menemme rannalle.",
        "pl": "Jutro będzie ładna pogoda i pójdziemy na plażę.", "cs": "Zítra bude hezké počasí a půjdeme na pláž.", "hu": "Holnap szép idő lesz, és megyünk a strandra.", "ro": "Mâine va fi vreme frumoasă și vom merge la plajă.",
        "tr": "Yarın hava güzel olacak ve plaja gideceğiz.", "id": "Besok cuaca akan bagus dan kita akan pergi ke pantai.", "vi": "Ngày mai thời tiết đẹp và chúng ta sẽ đi biển.", "uk": "Завтра буде гарна погода, і ми підемо на пляж.",
        "el": "Αύριο ο καιρός θα είναι καλός και θα πάμε στην παραλία.", "ja": "明日は天気がいいので、海に行きます。", "zh": "明天天气很好，我们去海边。", "ko": "내일은 날씨가 좋아서 바다에 갈 거예요.",
        "ar": "غدا سيكون الطقس جميلا وسنذهب إلى الشاطئ.", "he": "מחר יהיה מזג אוויר יפה ונלך לים.", "th": "พรุ่งนี้อากาศดีและเราจะไปทะเล",
    }
    df = spark.createDataFrame(list(sentences.items()), "lang string, t string")
    assert all(r.lang == r.t_lang for r in mr.detect_language(df, "t").collect()) and len(language.DECLARATION) >= 30


def test_balance(spark):
    df = spark.createDataFrame([(i, "a" if i < 70 else "b" if i < 90 else "c" if i < 97 else None) for i in range(100)], "id int, y string")
    count = lambda d: {r.y: r["count"] for r in d.groupBy("y").count().collect()}
    assert count(mr.check_and_handle_imbalance(df, "y", "under")) == {"a": 7, "b": 7, "c": 7, None: 3}
    over = mr.check_and_handle_imbalance(df, "y", "over")
    assert count(over) == {"a": 70, "b": 70, "c": 70, None: 3} and over.select("id").distinct().count() == 100
    assert mr.check_and_handle_imbalance(df, "y").count() == 100
    assert mr.check_problem_type(df, "id") == "regression" and mr.check_problem_type(df, "y") == "classification"
    with pytest.raises(ValueError):
        mr.check_and_handle_imbalance(df, "y", "both")


def test_pii(spark):
    rows = [("mail me@x.org or 4111 1111 1111 1111",), ("4111 1111 1111 1112 at 10.0.0.1",), ("123-45-6789 https://a.b/c (415) 555-2671",), ("clean",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    out = mr.detect_and_mask_pii(df)
    assert column(out, "t_masked") == ["mail <EMAIL_ADDRESS> or <CREDIT_CARD>", "4111 1111 1111 1112 at <IP_ADDRESS>", "<US_SSN> <URL> <PHONE_NUMBER>", "clean", ""]
    assert mr.detect_and_mask_pii(df, drop_original=True).columns == ["t_masked"]
    assert mr.detect_and_mask_pii(df.where("t = 'clean'")).columns == ["t"]


def test_spelling_within_two_edits(spark):
    """Against trying every word of the vocabulary; a known word stays, the nearest wins, then the most frequent."""
    rnd = random.Random(5)
    make = lambda: "".join(rnd.choices("abcde", k=rnd.randint(1, 6)))
    vocabulary = {make(): rnd.randint(1, 5) for _ in range(60)}
    texts = [" ".join(make() for _ in range(rnd.randint(0, 5))) for _ in range(80)] + [None, "", "  ", "ABC  abd", "x" * 300]

    def fixed(word):
        low = word.lower()
        if low in vocabulary:
            return word
        near = [(-d, n, w) for w, n in vocabulary.items() if (d := textprep.edit_distance(low, w)) <= 2]
        return max(near)[2] if near else word

    df = spark.createDataFrame([(i, t, "r", "f") for i, t in enumerate(texts)], "id int, t string, row string, fixed string").repartition(3)
    table = spark.createDataFrame(list(vocabulary.items()), "known string, n long")
    for known in (vocabulary, table):
        got = {r.id: (r.t, r.row, r.fixed) for r in mr.correct_spelling_text(df, ["t"], known).collect()}
        assert got == {i: (None if t is None else " ".join(map(fixed, t.split())), "r", "f") for i, t in enumerate(texts)}


def test_edit_distance():
    """Against edits of edits: equal within two, and such words have a form in common after deletions."""
    rnd = random.Random(1)

    def edits(w):
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        return {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1} | {a + c + b[1:] for a, b in cuts if b for c in "abc"} | {a + c + b for a, b in cuts for c in "abc"}

    for _ in range(600):
        a, b = ("".join(rnd.choices("abc", k=rnd.randint(0, 5))) for _ in range(2))
        want = 0 if a == b else 1 if b in edits(a) else 2 if any(b in edits(w) for w in edits(a)) else 3
        assert min(textprep.edit_distance(a, b), 3) == want
        assert want > 2 or textprep._deletions(a, 2) & textprep._deletions(b, 2)


def test_disguised_words(spark):
    """Look-alikes, marks, spaces and drawn-out letters; ten thousand words cost no more than ten."""
    listed = ["darn", "bad word", "hell", "class"] + [f"word{i}x" for i in range(10_000)]
    df = spark.createDataFrame([("Darn it, darned",), ("d4rn d@rn! d.a.r.n d a r n daaarn",), ("bad-word bad  word",), ("he11 h3ll hello shell",), ("<cl@ss> a b c d",), ("",), (None,)], "t string")
    want = ["**** it, darned", "**** ****! **** **** ****", "**** ****", "**** **** hello shell", "<****> a b c d", "", None]
    assert column(mr.redact_profanity(df, ["t"], listed), "t") == want
    assert column(mr.redact_profanity(df, ["t"], listed, disguised=False), "t")[1] == "d4rn d@rn! d.a.r.n d a r n daaarn"


def test_pii_spans_overlap(spark):
    """Spans of several kinds meet: the best stays, context decides between equals, and what does not touch it stays too."""
    find = lambda t, **k: [(t[a:b], kind) for a, b, kind, _ in pii.Finder(**k).spans(t)]
    assert find("NHS 943-476-5919") == [("943-476-5919", "UK_NHS")] and find("NHS 943-476-5918") == [("943-476-5918", "PHONE_NUMBER")]
    assert find("my phone is 943-476-5919") == [("943-476-5919", "PHONE_NUMBER")] and find("943-476-5919") == [("943-476-5919", "UK_NHS")]
    assert find("https://x.org/?mail=me@x.org ok") == [("me@x.org", "EMAIL_ADDRESS")]
    assert find("IBAN GB82WEST12345698765432 and GB82WEST12345698765431") == [("GB82WEST12345698765432", "IBAN_CODE")]
    assert find("ssn 123-45-6789, 000-12-3456, mac 00:1B:44:11:3A:B7") == [("123-45-6789", "US_SSN"), ("00:1B:44:11:3A:B7", "MAC_ADDRESS")]
    names = {"PERSON": ["Ann Lee", "Lee", "Ann"], "LOCATION": ["Lee on Sea", "São Paulo"]}
    assert find("ANN LEE on Sea, Lee, são paulo; annly", kinds=(), names=names) == [("ANN", "PERSON"), ("LEE on Sea", "LOCATION"), ("Lee", "PERSON"), ("são paulo", "LOCATION")]
    df = spark.createDataFrame([("Ann Lee, ann@lee.org",), ("",), (None,)], "t string")
    assert column(mr.detect_and_mask_pii(df, columns=["t"], names=names), "t_masked") == ["<PERSON>, <EMAIL_ADDRESS>", "", ""]
    spans = df.select(pii.pii_spans(F.col("t")).alias("s")).collect()
    assert [[(x.start, x.end, x.kind) for x in r.s] for r in spans] == [[(9, 20, "EMAIL_ADDRESS")], [], []]


def test_automaton_finds_all_phrases():
    rnd = random.Random(9)
    for _ in range(300):
        phrases = [tuple(rnd.choices("abc", k=rnd.randint(1, 4))) for _ in range(rnd.randint(1, 6))]
        words = rnd.choices("abcd", k=rnd.randint(0, 20))
        want = {(i, i + len(p)) for p in phrases for i in range(len(words)) if tuple(words[i : i + len(p)]) == p}
        assert set(automaton.Automaton(phrases).find(words)) == want


def test_json_and_types(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x"}', "c"), (2, '{"a": 2.5}', "c"), (3, "{bad}", "c"), (4, None, "c")], "id int, j string, k string")
    out = mr.fix_json_columns(df)
    assert out.columns == ["id", "k", "j_a", "j_b"] and [float(v) if v is not None else None for v in column(out, "j_a")] == [1.0, 2.5, None, None]
    assert mr.detect_json_sample(['{"a":1}', "[1]", "x"]) and not mr.detect_json_sample(['{"a":1} {"b":2}'])
    cleaned, report = mr.detect_column_types_and_process_text(spark.createDataFrame([(f"I can't stop {i} times, nor wait so long",) for i in range(60)], "t string"))
    assert report["t"]["type"] == "text" and cleaned.first().t.startswith("cannot stop")
    same, none = mr.detect_column_types_and_process_text(spark.createDataFrame([(1,)], "n int"))
    assert none == {} and same.columns == ["n"]


def test_language_spelling_profanity(spark):
    df = spark.createDataFrame([("the cat is on the mat and it was",), ("der Hund und die Katze",), ("le chat est dans la maison",), ("el perro que los gatos",), ("  ",), (None,)], "t string")
    assert column(mr.detect_language(df, "t"), "t_lang") == ["en", "de", "fr", "es", None, None]
    assert mr.filter_by_language(df, "t", "fr").count() == 1
    fixed = mr.correct_spelling_text(spark.createDataFrame([("teh cta sat",)], "t string"), ["t"], {"the": 9, "cat": 3, "sat": 1})
    assert column(fixed, "t") == ["the cat sat"]
    assert column(mr.redact_profanity(spark.createDataFrame([("Darn it, darned",)], "t string"), ["t"], ["darn"]), "t") == ["**** it, darned"]


def test_packed_grams_give_the_distances_of_the_plain_rule(monkeypatch):
    """Long and short texts of several scripts, ties, and texts counted in several steps; the plain rule is not asked but for far scripts."""
    from collections import Counter

    rnd = random.Random(3)
    profiles = {lang: p for lang, p in language.shipped_profiles().items() if lang in ("en", "de", "ru", "el")} | {"far": {"_": 0, "\u4e00": 1}}
    texts = [[], ["a"], ["\u4e00\u4e01", "b"], ["x" * 3000], *[["".join(rnd.choices("abcdefé\u0436\u03c9", k=rnd.randint(1, 9))) for _ in range(n)] for n in (3, 60, 900)]]
    plain = []
    for words in texts:
        own = language.ranking(Counter(words))
        plain.append([language.out_of_place(own, p) for p in profiles.values()] if own else None)
    for step in (7, 1 << 18):
        monkeypatch.setattr(language, "STEP", step)
        judge = language.Judge(profiles)
        assert [judge.distances("".join(f"_{w}_" for w in words)) for words in texts] == plain
    monkeypatch.setattr(language, "ranking", None)
    assert judge.distances("_das__ist_") is not None


@pytest.mark.parametrize("step", ["profanity", "pii", "json"])
def test_workers_take_small_batches_of_texts(spark, tmp_path, step):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    df = spark.createDataFrame([("darn it",)], "t string")
    if step == "profanity":
        mr.redact_profanity(df, ["t"], ["darn"])
    elif step == "pii":
        mr.detect_and_mask_pii(df, columns=["t"])
    else:
        (tmp_path / "x.json").write_text('[{"a": 1}]')
        mr.load_data(str(tmp_path / "x.json"), spark)
    assert 0 < int(spark.conf.get(key)) <= 400
