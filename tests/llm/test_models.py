"""Quality, toxicity, URL verdicts and pseudo-likelihood: held-out accuracy and brute force."""

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import pseudo_likelihood as lm
from millrace.llm import pu_quality, toxicity, url_filter
from millrace.llm.common import crc_mod

DATA = "/root/testdata/sf0.1"
ODD = ["", None, " ", "a", "word " * 60_000, "x" * 200_000, "É日本 \U0001f600", "same", "same"]


def docs(spark, texts):
    rows = [(i, t, 1.0, 2.0, 3, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, figures double, label int, lang string")


def auc(scores, labels):
    s, y = np.asarray(scores), np.asarray(labels)
    a, b = s[y == 1][:, None], s[y == 0][None]
    return (a > b).mean() + 0.5 * (a == b).mean()


def test_quality_held_out(spark):
    found = pu_quality.op4_quality(spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    held = found.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").toPandas()
    assert auc(held.score, held.quality) > 0.98
    assert held[held.quality == 1].predicted.mean() > 0.99 and held[held.quality == 0].predicted.mean() < 0.1
    assert found.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_prior_estimate():
    rng = np.random.default_rng(0)
    p, n = rng.normal(3, 1, 4000), rng.normal(-3, 1, 4000)
    u, cuts = np.concatenate([p[2000:], n[:2000]]), pu_quality.prior_cuts(p[:2000])
    above = np.array([(u >= c).mean() for c in cuts])
    assert pu_quality.lowest_ratio(p[:2000], above, cuts) == pytest.approx(0.5, abs=0.03)


def test_learner_takes_rows_evenly_at_every_size():
    """One document more than a round number changes hardly anything: no row is learnt from more often than another."""
    rng = np.random.default_rng(7)
    width, found = pu_quality._NAMES, {}
    good, bad = rng.normal(0.25, 1, (60_000, width)), rng.normal(-0.25, 1, (60_000, width))
    for rows in (16_400, 16_401, 50_003):
        x = np.concatenate([good[: rows // 2], bad[: rows - rows // 2]])
        learner = pu_quality.Learner(pu_quality._initial(), rng.normal(0.25, 1, (2000, width)), 0.5, seed=1)
        seen = []
        step = learner.step
        learner.step = lambda part: (seen.append(part), step(part))[1]
        pu_quality.learnt(learner, x, 500)
        assert learner.steps >= 500 and min(map(len, seen)) > 0.9 * pu_quality.BATCH
        assert sum(map(len, seen)) % rows == 0 and np.allclose(np.concatenate(seen).sum(axis=0), x.sum(axis=0) * (sum(map(len, seen)) // rows))
        out = pu_quality._forward(learner.layers, np.concatenate([good[-2000:], bad[-2000:]]))[1]
        found[rows] = auc(out, np.repeat([1, 0], 2000)), (out > 0).mean()
    assert max(a for a, _ in found.values()) - min(a for a, _ in found.values()) < 0.01
    assert all(abs(share - 0.5) < 0.1 for _, share in found.values())


def plain_quality(rows, positives, steps):
    """``fit`` without Spark for one learner, written from the formulas: its own Adam, ratios and level."""
    x = np.array([f for _, f, _ in rows], float)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    z = lambda v: np.clip((v - mean) / scale, -8, 8)
    p = np.array([f for i, f, _ in rows if i in positives], float)
    p = p[np.lexsort(p.T)]
    fold = np.array([zlib.crc32(v.astype("f4").tobytes()) % 2 == 0 for v in p])
    p = z(p)
    order = sorted(range(len(rows)), key=lambda r: (rows[r][2], rows[r][1][0]))
    xu = z(x[order])
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def grads(w, v, d):
        h = np.maximum(v @ w[0] + w[1], 0)
        g = d(h @ w[2] + w[3][0])
        back = np.outer(g, w[2]) * (h > 0)
        return [v.T @ back, back.sum(axis=0), h.T @ g, np.array([g.sum()])]

    def train(p, prior, turns):
        w = pu_quality._initial()
        for turn in range(turns):
            rng, first, second, t = np.random.default_rng(turn), [0.0] * 4, [0.0] * 4, 0
            each = max(1, round(len(xu) / 256))
            for _ in range(math.ceil(steps / each)):
                for part in np.array_split(rng.permutation(len(xu)), each):
                    a, n = xu[part], len(part)
                    b = p[rng.integers(0, len(p), n)]
                    out = lambda v: np.maximum(v @ w[0] + w[1], 0) @ w[2] + w[3][0]  # noqa: B023, E731
                    if prior is None:
                        g = [i + j for i, j in zip(grads(w, b, lambda o: (sigmoid(o) - 1) / n), grads(w, a, lambda o: sigmoid(o) / n))]  # noqa: B023
                    else:
                        sign = 1 if np.log1p(np.exp(out(a))).mean() >= prior * np.log1p(np.exp(out(b))).mean() else -1
                        own = (lambda o: prior * (sigmoid(o) - 1 - sigmoid(o)) / n) if sign > 0 else (lambda o: prior * sigmoid(o) / n)  # noqa: B023
                        g = [i + j for i, j in zip(grads(w, b, own), grads(w, a, lambda o: sign * sigmoid(o) / n))]  # noqa: B023
                    t += 1
                    for k in range(4):
                        d = g[k] + 1e-5 * w[k]
                        first[k], second[k] = 0.9 * first[k] + 0.1 * d, 0.999 * second[k] + 0.001 * d * d
                        w[k] = w[k] - 0.005 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
            w = [np.float32(v).astype(float) for v in w]
        return lambda v: np.maximum(v @ w[0] + w[1], 0) @ w[2] + w[3][0]

    plain = train(p[fold], None, 1)
    cuts = np.quantile(plain(p[~fold]), [k / 50 for k in range(46)])
    prior = min(max(min((plain(xu) >= c).mean() / (plain(p[~fold]) >= c).mean() for c in cuts), 0.05), 0.97)
    falls = []
    for part in (fold, ~fold):
        g = train(p[part], prior, 3)
        low, middle = np.quantile(g(p[part]), [0.001, 0.5])
        falls.append((low - np.quantile(g(p[~part]), 0.001)) / (middle - low))
    g = train(p, prior, 3)
    low, middle = np.quantile(g(p), [0.001, 0.5])
    cut = low - (max(0, *falls) + 0.25) * (middle - low) - 1e-3
    return prior, 1 / (1 + np.exp(-(g(z(x)) - cut + np.log(0.3 / 0.7))))


def test_quality_equals_a_plain_version(spark):
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    described = pu_quality.describe(docs_)
    rows = [(r.doc_id, r.figures, r.key) for r in described.select("doc_id", "figures", F.xxhash64("doc_id", "figures", F.lit(None).cast("long")).alias("key")).collect()]
    positives = {r.doc_id for r in pu_quality.trusted(spark.read.parquet("/root/testdata/sf0.01/labels.parquet")).collect()}
    model = pu_quality.fit(described, pu_quality.trusted(spark.read.parquet("/root/testdata/sf0.01/labels.parquet")), steps=60)
    prior, scores = plain_quality(rows, positives, 60)
    assert model.prior == pytest.approx(prior, rel=1e-6)
    got = {r.doc_id: r.s for r in described.select("doc_id", pu_quality.score_figures(described, model).alias("s")).collect()}
    np.testing.assert_allclose([got[i] for i, _, _ in rows], scores, atol=2e-4)


def test_quality_does_not_depend_on_files(spark):
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = pu_quality.trusted(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    one, other = (pu_quality.fit(pu_quality.describe(d), known, steps=30) for d in (docs_.coalesce(1), docs_.repartition(9)))
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(one.layers, other.layers)) and one.level == pytest.approx(other.level, abs=1e-4)


def test_learners_hold_every_row_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pu_quality, "SHARD_ROWS", 100)
    monkeypatch.setattr(pu_quality, "BLOCK_ROWS", 50)
    width = pu_quality._NAMES
    rows = [(None if i % 3 == 0 else 5, [float(i % 7 == 0)] * width) for i in range(1200)]
    own = spark.createDataFrame(rows, "id long, figures array<float>").repartition(4)
    found = pu_quality.learners(own, 1200).collect()
    assert sum(r.n for r in found) == 1200 and len({r.shard for r in found}) == len(found)
    assert sum(np.frombuffer(r.x, "<f4").sum() for r in found) == sum(sum(f) for _, f in rows)


def test_non_negative_risk_gradient():
    """The step's direction is the risk's slope, or its opposite where the estimated negative risk is below zero."""
    rng = np.random.default_rng(1)
    layers = [rng.normal(size=(4, 5)), rng.normal(size=5), rng.normal(size=5), rng.normal(size=1)]
    x = rng.normal(size=(30, 4))
    grads = pu_quality._gradient(layers, x, lambda g: pu_quality._sigmoid(g) / len(x))
    loss = lambda ls: np.logaddexp(0, pu_quality._forward(ls, x)[1]).mean()
    for k, g in enumerate(grads):
        for at in list(np.ndindex(g.shape))[:6]:
            up, down = [w.copy() for w in layers], [w.copy() for w in layers]
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert g[at] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-5)


def test_quality_cases(spark):
    frame = docs(spark, ODD)
    described = pu_quality.describe(frame)
    assert described.count() == len(ODD)
    none = pu_quality.fit(described, spark.createDataFrame([], "doc_id long"))
    assert {r.s for r in described.select(pu_quality.score_figures(described, none).alias("s")).collect()} == {0.5}
    some = pu_quality.fit(described, spark.createDataFrame([(7,), (8,), (8,), (None,)], "doc_id long"), steps=20)
    scores = [r.s for r in frame.select(pu_quality.score(frame, some).alias("s")).collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] and scores[7] == scores[8]
    assert pu_quality.describe(docs(spark, [])).count() == 0
    assert pu_quality.fit(pu_quality.describe(docs(spark, [])), spark.createDataFrame([(1,)], "doc_id long")).layers == []


def test_toxicity_held_out(spark):
    found = toxicity.op6_toxicity(spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    held = found.where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    assert auc(held.score, held.toxic) > 0.95
    assert held[held.toxic == 1].predicted.mean() > 0.8 and held[held.toxic == 0].predicted.mean() < 0.01


def test_ftrl_against_its_formula():
    rng = np.random.default_rng(2)
    own = toxicity.Ftrl(6, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z, n = np.zeros(7), np.zeros(7)
    for _ in range(60):
        at = np.flatnonzero(rng.random(7) < 0.5)
        y = int(rng.random() < 0.5)
        w = np.array([0.0 if abs(z[i]) <= 0.1 else -(z[i] - np.sign(z[i]) * 0.1) / ((1 + n[i] ** 0.5) / 0.5 + 0.2) for i in range(7)])
        assert np.allclose(own.weights(), w)
        g = (1 / (1 + np.exp(-w[at].sum())) - y) * (toxicity.POSITIVE_WEIGHT if y else 1)
        for i in at:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5 * w[i]
            n[i] += g * g
        own.update(at, y)


def test_toxicity_cases(spark):
    frame = docs(spark, ODD)
    none = toxicity.fit(frame, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.s for r in frame.select(toxicity.score(frame, none).alias("s")).collect()} == {0.5}
    labels = spark.createDataFrame([(7, 1), (8, 1), (3, 0), (3, 0), (4, None), (None, 1), (0, 0)], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    scores = [r.s for r in frame.select(toxicity.score(frame, model).alias("s")).collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] and scores[7] == scores[8]
    assert len(toxicity.features("one two three four")) == 4 + 0 + 3 + 2 + 1


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def slow_verdicts(rows):
    """The whole method with dictionaries."""
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)

    def parse(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        path = rest[cut:]
        return lower(rest[:cut]), path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]

    out, edges, seeds = {}, defaultdict(float), {"allow": defaultdict(float), "block": defaultdict(float)}
    hosts = set()
    for i, url, html in rows:
        host, path = parse(url)
        fit = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        rule = max(fit, key=lambda r: len(r[1] + r[2])) if fit else None
        out[i] = [host, path, rule[1] + rule[2] if rule else None, rule[0] if rule else None]
        if host:
            hosts.add(host)
            if rule:
                seeds[rule[0]][host] += 1
        for quoted, single, bare in re.findall(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", html or "", re.IGNORECASE):
            link = (quoted or single or bare).strip(" ")
            other = parse("http:" + link if link.startswith("//") else link)[0]
            if host and other and other != host:
                edges[(host, other)] += 1
                hosts.add(other)
    chain = set()
    for h in hosts:
        labels = h.split(".")
        chain |= {(".".join(labels[k:]), ".".join(labels[k + 1 :])) for k in range(len(labels) - 2)}
    for low, high in chain:
        edges[(low, high)] += 1
        edges[(high, low)] += 1

    def rank(edges, seed):
        total = defaultdict(float)
        for (a, _), w in edges.items():
            total[a] += w
        seed = {h: w / sum(seed.values()) for h, w in seed.items()}
        now = dict(seed)
        for _ in range(url_filter.ROUNDS):
            new = defaultdict(float, {h: 0.15 * w for h, w in seed.items()})
            for (a, b), w in edges.items():
                new[b] += 0.85 * now.get(a, 0) * w / total[a]
            now = new
        return now

    trust, distrust = rank(edges, seeds["allow"]), rank({(b, a): w for (a, b), w in edges.items()}, seeds["block"])
    for v in out.values():
        v[3] = v[3] or ("block" if distrust.get(v[0], 0) > trust.get(v[0], 0) * (1 + 1e-9) else "allow")
    return {i: tuple(v) for i, v in out.items()}


@pytest.mark.parametrize("together", [10_000, 2])
def test_url_verdicts_against_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(url_filter, "EDGES_TOGETHER", together)
    link = lambda *hosts: "".join(f'<a href="{h}">x</a>' for h in hosts)
    rows = [
        (1, "http://A.Example.ORG/es/1", link("https://b.net/x", "//c.net")),
        (2, "https://b.net", link("http://bad.com/de/", "http://bad.com/q", "/rel", "mailto:x")),
        (3, "http://bad.com/de/x?y#z", None),
        (4, "http://bad.com/other", link("http://B.NET/")),
        (5, "http://good.com/fr/", link("http://c.net", "http://d.net")),
        (6, "http://c.net/?q=/fr/", ""),
        (7, "http://example.org/en/12", link(*[f"http://h{k}.net" for k in range(9)])),
        (8, "http://example.org", None),
        (9, None, link("http://x.net")),
        (10, "no scheme", ""),
        (11, "ftp://x.y.example.org/en/2\nz", ""),
        (12, "http://h3.net/#", "x"),
        (13, "://", ""),
        (14, "http://.com/de/", ""),
        (15, "http://single.net", "<A HREF='http://bad.com/x'>x</A>"),
        (16, "http://bare.net", "<a class=y href = http://bad.com/y>x</a> <a href=/z>"),
        (17, "http://spaced.net", '<a HReF=" http://bad.com ">x</a>'),
    ]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, verdict string").repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.verdicts(frame).collect()}
    assert got == slow_verdicts(rows)
    assert url_filter.verdicts(frame.limit(0)).count() == 0


def test_many_allowed_pages_do_not_drown_distrust(spark):
    """A thousand allowed pages and one blocked page: who links to the blocked host alone is suspect all the same."""
    rows = [(i, f"http://good.com/fr/{i}", '<a href="http://far.net">') for i in range(1000)]
    rows += [(1000, "http://bad.com/de/", ""), (1001, "http://helper.net", '<a href="http://bad.com/de/">'), (1002, "http://far.net", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.verdicts(frame).where("page_id >= 1000").collect()}
    assert got[1001][3] == "block" and got[1002][3] == "allow"
    assert got == {k: v for k, v in slow_verdicts(rows).items() if k >= 1000}
    assert 0.85**url_filter.ROUNDS < url_filter.TOLERANCE


def test_network_gradient_and_normalisation():
    rng = np.random.default_rng(0)
    flat = lm.initial().astype(np.float64)
    context, target = rng.integers(0, lm.VOCABULARY + 1, (40, 4)), rng.integers(0, lm.VOCABULARY, 40)
    g = lm.gradient(lm.unpack(flat), context, target)
    for k in np.flatnonzero(np.abs(g) > 1e-4)[::4000]:
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        slope = -(lm.log_probabilities(lm.unpack(up), context, target).mean() - lm.log_probabilities(lm.unpack(down), context, target).mean()) / 2e-5
        assert g[k] == pytest.approx(slope, abs=1e-4)
    every = lm.log_probabilities(lm.unpack(flat), np.repeat(context[:1], lm.VOCABULARY, 0), np.arange(lm.VOCABULARY))
    assert np.exp(every).sum() == pytest.approx(1.0)


def test_scores_are_sums_over_windows(spark):
    model = lm.Model(["the", "cat", "sat"], lm.initial())
    net, index = lm.unpack(model.flat), model.index()
    texts = [*ODD[:5], "The cat sat on the mat"]
    frame = docs(spark, texts)
    for r in frame.select("doc_id", lm.score(frame, model).alias("s")).select("doc_id", "s.*").collect():
        ids = lm.token_ids(texts[r.doc_id], index)
        line = [lm.PAD] * 2 + ids.tolist() + [lm.PAD] * 2
        want = sum(float(lm.log_probabilities(net, np.array([[line[i], line[i + 1], line[i + 3], line[i + 4]]]), np.array([t]))[0]) for i, t in enumerate(ids.tolist()[:300]))
        assert r.n_tokens == len(ids)
        if len(ids) <= 300:
            assert r.pll == pytest.approx(want, abs=1e-3)
        else:
            assert np.isfinite(r.pll)


def test_training_beats_frequencies(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(3)
    model = lm.fit(rows, stride=2)
    texts = [r.text for r in rows.select("text").limit(200).collect()]
    ids = np.concatenate([lm.token_ids(t, model.index()) for t in texts])
    share = np.bincount(ids, minlength=lm.VOCABULARY) / len(ids)
    n, sums = lm.pseudo_log_likelihoods(lm.unpack(model.flat), model.index(), texts)
    assert sums.sum() / n.sum() > np.log(share[ids]).mean()
    empty = lm.fit(rows.limit(0))
    assert empty.words == [] and (empty.flat == lm.initial()).all()


def test_every_position_is_learnt_from_once(spark, monkeypatch):
    """Documents of 1 to 7 tokens, laid end to end in one task: the passes' counts add up to all tokens."""
    frame = docs(spark, [" ".join(f"w{i}x{k}" for k in range(1 + i % 7)) for i in range(60)] + [None, ""]).coalesce(1)
    learnt = []
    average = lm.average
    monkeypatch.setattr(lm, "average", lambda shards: learnt.append(sum(r.n for r in shards.select("n").collect())) or average(shards))
    model = lm.fit(frame)
    total = sum(1 + i % 7 for i in range(60))
    assert sum(learnt) == total == len(model.words)


def test_every_word_has_its_own_probability(spark):
    """Rare words of one bucket differ by their counts, and the probabilities of all words sum to one."""
    bucket = lambda w: lm.token_ids(w, {})[0]
    twin = next(w for w in (f"w{k}" for k in range(10_000)) if bucket(w) == bucket("rare"))
    texts = ["rare"] * 3 + [twin, "the", None, "", "the " + " ".join(f"v{k}" for k in range(2000))]
    frame = docs(spark, texts).repartition(3)
    model = lm.Model(["the"], lm.initial())
    found = {r.doc_id: r for r in lm.log_likelihoods(frame, model, lm.word_counts(frame)).collect()}
    shares = {r.word: r.log_share for r in lm.word_shares(lm.word_counts(frame), model.words).collect()}
    assert len(found) == len(texts) and len(shares) == 2002
    assert found[0].pll - found[3].pll == pytest.approx(np.log(3), abs=1e-5)
    assert found[5].pll == found[6].pll == 0 and found[5].mean is None and found[6].n_tokens == 0
    net, index = lm.unpack(model.flat), model.index()
    for i in (0, 4, 7):
        n, sums = lm.pseudo_log_likelihoods(net, index, [texts[i]])
        assert found[i].n_tokens == n[0] and found[i].pll == pytest.approx(sums[0] + sum(shares.get(w, 0.0) for w in lm.words_of(texts[i])), rel=1e-5)
    every = lm.log_probabilities(net, np.full((lm.BUCKETS, 4), lm.PAD), np.arange(lm.WORDS, lm.VOCABULARY))
    assert sum(np.exp(every[bucket(w) - lm.WORDS] + x) for w, x in shares.items()) == pytest.approx(np.exp(every).sum(), rel=1e-5)


def test_chunks_and_parts_of_the_dictionary(spark, monkeypatch):
    """Chunks of many and of single texts, a dictionary of many parts: words cross once a chunk, and the corpus's own counts give what a table of counts gives."""
    texts = [" ".join(f"w{(i * k) % 97} rare{i % 7} the" for k in range(i)) for i in range(60)] + [None, "", "!", "the " * 3000, "\u0130 \u00c9t\u00e9"]
    frame = docs(spark, texts).repartition(2)
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 500)
    monkeypatch.setattr(lm, "PART_TOKENS", 1500)
    chunks = lm.chunked(frame)
    answers = lm.dictionary(chunks)
    counts = lm.word_counts(frame)
    words = lm.most_frequent(lm.frequent(answers), 20)
    assert words == lm.most_frequent(counts, 20)
    parts = 1 + sum(len(lm.words_of(t)) for t in texts) // 1500
    assert chunks.count() > 5 and parts > 3 and answers.count() <= parts * (chunks.count() + 1)
    lists = {r.chunk: len(lm._strings(r.words)) for r in chunks.select("chunk", "words").collect()}
    assert max(lists.values()) <= counts.count()
    model = lm.Model(words, lm.initial())
    net, index = lm.unpack(model.flat), model.index()
    shares = {r.word: r.log_share for r in lm.word_shares(counts, words).collect()}
    own, given = ({r.doc_id: r for r in x.collect()} for x in (lm.log_likelihoods(frame, model, lm.frequent(answers), chunks=chunks, answers=answers), lm.log_likelihoods(frame, model, counts)))
    assert own == given and len(own) == len(texts)
    for i, text in enumerate(texts):
        n, sums = lm.pseudo_log_likelihoods(net, index, [text])
        assert own[i].n_tokens == n[0] == len(lm.words_of(text)) and (own[i].mean is None) == (n[0] == 0)
        assert own[i].pll == pytest.approx(sums[0] + sum(shares.get(w, 0.0) for w in lm.words_of(text)), rel=1e-4, abs=1e-4)


def test_logits_beyond_the_safe_bounds():
    """Weights so large that exponentials overflow: the rows' greatest logits are taken off, probabilities and slopes stay finite."""
    rng = np.random.default_rng(3)
    context, target = rng.integers(0, lm.VOCABULARY + 1, (50, 4)), rng.integers(0, lm.VOCABULARY, 50)
    net = lm.unpack(lm.initial() * np.float32(400))
    assert not lm._safe(net) and lm._safe(lm.unpack(lm.initial()))
    assert np.isfinite(lm.log_probabilities(net, context, target)).all() and np.isfinite(lm.gradient(net, context, target)).all()
    every = lm.log_probabilities(net, np.repeat(context[:1], lm.VOCABULARY, 0), np.arange(lm.VOCABULARY))
    assert np.exp(every).sum() == pytest.approx(1.0, rel=1e-4)


def test_averaging_in_groups(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN_IN", 3)
    rng = np.random.default_rng(0)
    rows = [(k, k % 4, bytearray(rng.normal(size=5).astype(np.float32).tobytes())) for k in range(20)]
    got = lm.average(spark.createDataFrame(rows, "shard long, n long, w binary"))
    want = sum(n * np.frombuffer(w, np.float32).astype(float) for _, n, w in rows) / sum(n for _, n, _ in rows)
    assert np.allclose(got, want, atol=1e-5)


def test_held_out_rule(spark):
    assert {r.m for r in spark.range(30).select(crc_mod("id", 5).alias("m")).collect()} <= set(range(5))
