"""No internal name meets a user's: operators on a table whose columns are called like everything used inside."""

import random

import pytest
from pyspark.sql import functions as F

import millrace as mr
from millrace.functions.storage import cut, fresh_name, shared_dir
from millrace.operators import dedupe

TAKEN = (
    "at text whose first gone from to row place order score key group low high hash slot rank class cut rest times object0 g x n q v value count "
    "sides total s means tuple tokens lang word fill part cell __row __h __s __y __c __g __x0 __g0 __from __to __key __score __tokens __lang __place __tuple __means"
).split()


@pytest.fixture(scope="module")
def crowded(spark):
    rows = [
        (i, ["red gate", "red gat", "old mill", "a fine text about the mill", None][i % 5], float(i % 17) if i % 6 else None, float(i * i % 23) if i % 7 else None, ["a", "a", "a", "b"][i % 4], f'{{"u": {i}}}', *[f"{c}{i}" for c in TAKEN])
        for i in range(60)
    ]
    return spark.createDataFrame(rows, "id long, words string, one double, two double, label string, doc string, " + ", ".join(f"`{c}` string" for c in TAKEN)).repartition(3)


OPERATORS = {
    "near_duplicate_text": lambda df: mr.near_duplicate_text(df, "words", 80, order_by="id"),
    "fuzzy_deduplicate": lambda df: mr.fuzzy_deduplicate(df, ["words"], 80, order_by="id"),
    "drop_duplicates_first": lambda df: mr.drop_duplicates_subset(df, ["words", "key"], "first", "id"),
    "drop_duplicates_none": lambda df: mr.drop_duplicates_subset(df, ["words", "row"], "none"),
    "fuzzy_cluster": lambda df: mr.fuzzy_cluster_categories(df, ["words"], 80),
    "rare": lambda df: mr.group_rare_categories(df, 0.3, columns=["words"]),
    "label": lambda df: mr.encode_categorical(df, "label", ["label"]),
    "frequency": lambda df: mr.encode_categorical(df, "frequency", ["label"]),
    "corrector": lambda df: mr.fix_spelling_errors_in_categorical(df.select("id", "words", *[F.col(c).alias(c) for c in TAKEN]), corrector=lambda name, values: values),
    "isolation_forest": lambda df: mr.remove_outliers_isolation_forest(df, columns=["one", "two"]),
    "outliers_by_group": lambda df: mr.remove_outliers_by_group(df, "label", ["one"]),
    "knn": lambda df: mr.impute_missing(df, "knn", columns=["one", "two"]),
    "mice": lambda df: mr.impute_missing(df, "mice", columns=["one", "two"]),
    "ffill": lambda df: mr.impute_missing(df, "ffill", columns=["one"], order_by="id"),
    "interpolate": lambda df: mr.impute_missing(df, "interpolate", columns=["one"], order_by="id"),
    "under": lambda df: mr.check_and_handle_imbalance(df, "label", "under"),
    "over": lambda df: mr.check_and_handle_imbalance(df, "label", "over"),
    "duplicate_columns": mr.remove_duplicate_columns,
    "json": mr.fix_json_columns,
    "references": lambda df: mr.check_referential_integrity(df, "label", df.select("label").distinct(), True)[0],
    "language": lambda df: mr.detect_language(df, "words", "found"),
    "filter_language": lambda df: mr.filter_by_language(df, "words"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_user_columns_stay(crowded, name):
    out = OPERATORS[name](crowded)
    assert set(TAKEN) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    for r in out.select("id", *TAKEN).collect():
        assert all(r[c] == f"{c}{r.id}" for c in TAKEN)


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "Key int, _key int")
    assert fresh_name(df, "key") == "__key" and fresh_name(df, "other") == "other"
    assert shared_dir(spark) and cut(df).collect() == df.collect()


def test_balance_by_tables(spark):
    """Half of the rows in one class, many classes, classes of one row: exact sizes, and every row is one of the table's."""
    rows = [(i, "big" if i < 300 else f"c{i % 60}" if i < 599 else "one") for i in range(600)] + [(600 + i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, label string").repartition(5)
    known = dict(rows)
    for method in ("under", "over"):
        got = mr.check_and_handle_imbalance(df, "label", method).collect()
        sizes = {k: sum(1 for r in got if r.label == k) for k in {r.label for r in got} - {None}}
        assert set(sizes.values()) == {1 if method == "under" else 300} and len(sizes) == 62
        assert all(known[r.id] == r.label for r in got) and sum(r.label is None for r in got) == 5


def test_equal_orders_are_spread_over_ranges(spark, monkeypatch):
    from millrace.operators import missing

    seen = []
    monkeypatch.setattr(missing, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    df = spark.range(20_000).select(F.lit(1).alias("t"), F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).alias("x")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one range
    try:
        assert mr.impute_missing(df, "ffill", columns=["x"], order_by="t").where("x is null").count() <= 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in seen[0].groupBy("range").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 0.6 * 20_000


def test_common_grams_are_keys_only_with_others(spark, monkeypatch):
    """No pair is lost among texts of one pattern; where texts share a word only, no key is shared by more than the stated number."""
    import itertools

    from millrace.functions.ratio import ratio

    monkeypatch.setattr(dedupe, "HOT_ROWS", 12)
    kinds = [a + b for a, b in itertools.product("abcdefgh", "pqrstuvw")]
    texts = [f"common part {k} of number {i:03d}" for i, k in enumerate(kinds * 2)] + ["ab", "abc", "b", "", "common"]
    df = spark.createDataFrame(list(enumerate(texts)), "place long, text string")
    for threshold in (80, 96):
        got = {(r.a, r.b) for r in dedupe.similar_pairs(df, threshold).collect()}
        assert got == {(i, j) for (i, x), (j, y) in itertools.combinations(enumerate(texts), 2) if ratio(x, y) >= threshold}
    rnd = random.Random(4)
    loose = [f"common {''.join(rnd.choices('abcdefghij', k=12))} {''.join(rnd.choices('abcdefghij', k=12))}" for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(loose)), "place long, text string")
    assert dedupe.blocked(df, 96).groupBy("key").count().agg(F.max("count")).first()[0] <= dedupe.HOT_ROWS


def test_texts_that_resemble_each_other_are_settled_without_pairs(spark, monkeypatch):
    """Addresses of a few hosts: the greedy rule in heads of few texts, against the rule one by one; no list of pairs is made."""
    from millrace.functions.ratio import ratio

    rnd = random.Random(11)
    texts = list({f"https://{rnd.choice(['www.alpha', 'm.beta', 'gamma'])}.example.{rnd.choice(['org', 'net'])}/{rnd.choice(['de', 'fr'])}/{rnd.randrange(10**rnd.randint(1, 6))}{rnd.choice(['', '#top', '?page=2&ref=x'])}": 0 for _ in range(400)})
    kept, want = [], {}
    for i, t in enumerate(texts):
        head = next((k for k in kept if ratio(t, texts[k]) >= 90), None)
        want[i] = head
        kept += [i] * (head is None)
    assert 40 < len(kept) < 300
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "place long, text string").repartition(5)
    monkeypatch.setattr(dedupe, "similar_pairs", lambda *_: pytest.fail("pairs were listed"))
    monkeypatch.setattr(dedupe, "HEAD", 50)
    assert dedupe.resemble_each_other(df, 90)
    assert {r.place: r["head"] for r in dedupe.heads(df, 90).collect()} == {i: h for i, h in want.items() if h is not None}
    for _ in range(300):
        a, b = ("".join(rnd.choices("abcé/", k=rnd.randint(0, 30))) for _ in range(2))
        apart = (int.from_bytes(dedupe.signature(a), "little") ^ int.from_bytes(dedupe.signature(b), "little")).bit_count()
        assert apart <= (1 - ratio(a, b) / 100) * (len(a) + len(b)) + 1e-6
    assert dedupe.settled_heads(df.limit(0), 90).count() == 0
