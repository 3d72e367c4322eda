"""Token counts, centroid clustering and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import centroids, importance, token_counts

DATA = "/root/testdata/sf0.01"
ODD = ["", None, "a", " ", "   ", "\n\n a", "a ", "x  y   z", "▁▁a▁", "<s>x</s> <unk>", "日本語 テキスト 123", "\U0001f600 é ü", "word " * 30_000, "x" * 20_000, "a\x00b", "tab\there\r\n", "　  ", "same one", "same one"]


# ---- token counts


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=token_counts.default_path())


def odd_documents(spark):
    rows = [(i if i % 5 else None, t, "x", 1, 2, b"z") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, keys string, n_tokens int, n_bytes int, part binary")


def test_counts_equal_the_library(spark, processor):
    want = sorted((-1 if i % 5 == 0 else i, len((t or "").encode()), len(processor.encode(t or ""))) for i, t in enumerate(ODD))
    for table in (None, [], ["a", "word", "\na", ""]):
        got = token_counts.count_tokens(odd_documents(spark), table=table).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts.count_tokens(odd_documents(spark).limit(0)).count() == 0


def test_query_counts_every_document(spark, processor):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = token_counts.op11_token_counts(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(processor.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab th\n\t▁é日\U0001f600<s>\x00　"), max_size=50))
def test_cuts_change_no_count(text):
    own = token_counts.Lengths(token_counts.default_path()) if not hasattr(test_cuts_change_no_count, "own") else test_cuts_change_no_count.own
    test_cuts_change_no_count.own = own
    assert own.count(text) == len(own.processor.encode(text))


def test_frequent_pre_tokens_are_found(spark):
    """What makes up more than one in ``size`` of all pre-tokens is in the table, through many tasks and merges."""
    rnd = random.Random(3)
    words = ["the"] * 300 + ["of"] * 200 + [f"w{i}" for i in range(4000)]
    rnd.shuffle(words)
    texts = [(" ".join(words[i : i + 9]),) for i in range(0, len(words), 9)]
    df = spark.createDataFrame(texts, "text string").repartition(70)
    found = token_counts.frequent(df, size=30)
    assert len(found) <= 30 and {"the", "of"} <= set(found)
    assert token_counts.frequent(df.limit(0)) == []


def test_summaries_stay_within_their_bound():
    rnd = random.Random(4)
    parts = [Counter(rnd.choices(range(200), [1 / (i + 1) for i in range(200)], k=3000)) for _ in range(20)]
    total, held = sum(parts, Counter()), Counter()
    for part in parts:
        held.update(token_counts.shrunk(Counter({str(k): n for k, n in part.items()}), 40))
        held = token_counts.shrunk(held, 40)
    lost = sum(total.values()) / 41
    assert all(total[k] - lost <= held[str(k)] <= total[k] for k in total)


def test_a_vocabulary_without_safe_cuts_is_not_cut():
    class Joined:
        normalize = staticmethod(lambda t: token_counts.MARK + t.replace(" ", token_counts.MARK))
        pieces = ["▁", "a", "a▁b"]
        id_to_piece = pieces.__getitem__
        get_piece_size = staticmethod(lambda: 3)
        is_control = is_unknown = staticmethod(lambda i: False)

    assert token_counts.cutting_pattern(Joined()) is None
    Joined.pieces[2] = "a\n"
    assert "\n" not in token_counts.cutting_pattern(Joined())
    Joined.normalize = staticmethod(str.lower)
    assert token_counts.cutting_pattern(Joined()) is None


# ---- centroids


def plain_clusters(rows, k=16, rounds=3):
    """All distances, all rounds, in Python integers."""
    kept = [(i, [math.floor(64 * float(v)) for v in e]) for i, e in rows if e is not None and len(e) == 64 and all(v is not None and math.isfinite(v) for v in e)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centres = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        members = [[] for _ in centres]
        for _, x in kept:
            members[near(x)[1]].append(x)
        centres = [[sum(col) // len(m) for col in zip(*m)] if m else c for m, c in zip(members, centres)]
    return centres, [(i, *near(x)[::-1]) for i, x in kept]


def test_clusters_equal_a_plain_version(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), e.tolist()) for i, e in enumerate(rng.normal(0, 0.4, (60, 64)).astype("f4"))]
    rows += [(100 + i, rows[3][1]) for i in range(40)] + [(7, rows[8][1]), (None, rows[9][1]), (None, rows[5][1])]
    rows += [(200, [0.0] * 64), (201, [-0.001] * 64), (202, [1000.0] + [0.0] * 63)]
    rows += [(300, None), (301, [0.1] * 63), (302, [0.1] * 63 + [float("nan")]), (303, [None] + [0.1] * 63), (304, [float("inf")] * 64), (305, [])]
    df = spark.createDataFrame([(i, e, "c", 5) for i, e in rows], "vec_id long, embedding array<float>, cluster string, x int").repartition(5)
    centres, want = plain_clusters(rows)
    found = centroids.cluster(df)
    assert found.centres.tolist() == centres
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([tuple(r) for r in found.members.collect()], key=key) == sorted(want, key=key)
    assert found.inertia == {c: sum(d for _, k, d in want if k == c) for c in {k for _, k, _ in want}}


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 64)], "vec_id long, embedding array<double>")
    found = centroids.cluster(df)
    assert len(found.centres) == 2 and {(r.cluster, r.distance) for r in found.members.collect()} == {(0, 0)}
    assert centroids.cluster(df.limit(0)).members.count() == 0
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).members.count()


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(0, 26))
def test_bounds_never_exceed_distances(seed, bits):
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-(2**bits), 2**bits + 1, (20, 64)), rng.integers(-(2**bits), 2**bits + 1, (6, 64))
    x[:6] = c + rng.integers(-1, 2, c.shape)
    c[5] = c[0]
    exact = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    v, centres = centroids.Vectors.of(x), centroids.Centres.of(c)
    assert (centroids.lower_bounds(v, centres) <= exact).all()
    best, far, compared = centroids.nearest(v, centres)
    assert (best == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all() and compared <= exact.size


def test_screening_saves_distances(spark):
    found = centroids.cluster(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    assert found.pruned > 0.5


# ---- importance resampling


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]


def plain_draw(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for i, text in docs:
        words, found = features(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, len(words)])
    able = [r for r in out if r[5] >= 20]
    drawn = sorted([r for r in able if r[3] is not None], key=lambda r: (-r[3], r[0]))[: 25 * len(able) // 100]
    for k, r in enumerate(drawn):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:4], r[4] or 0))


@pytest.mark.parametrize("chunk, part", [(1 << 24, 1 << 24), (300, 500), (1, 10_000)])
def test_draw_equals_a_plain_version(spark, chunk, part):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(50)] + ["Été", "ÀB", "日本", "x1", "İ"]
    texts = [" ".join(rnd.choices(words, [1 / (i + 1) for i in range(len(words))], k=rnd.randint(0, 60))) for _ in range(120)]
    texts += [None, "", "  ", "A-B_c!d", "one " * 3000, texts[5], texts[5], "\x00a\x7fb`c{d~ e"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, texts[5]), (None, texts[7]), (None, None)]
    target = [None, "", "w1 w2 w3 " * 20, "x1 日本 Été " * 5]
    df = spark.createDataFrame([(i, t, "f", 1, 2.0, 3) for i, t in docs], "doc_id long, text string, file string, place int, weight double, rank int").repartition(3)
    aimed = spark.createDataFrame([(t,) for t in target], "text string")
    weights = importance.weigh(df, aimed, part_bytes=part, chunk_bytes=chunk)
    got = importance.resample(weights).select("doc_id", "n_features", "weight", "score", "rank")
    assert by_id(got.collect()) == by_id(plain_draw(docs, target))


def test_empty_tables_and_other_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(importance.weigh(none, none)).count() == 0
    named = spark.createDataFrame([("b", "one two " * 20), ("a", "one two " * 20), ("c", None)], "doc_id string, text string")
    rows = importance.resample(importance.weigh(named, none), share=100).collect()
    assert {r.doc_id: r.n_features for r in rows} == {"a": 79, "b": 79, "c": 0}
    assert sorted(r["rank"] for r in rows if r["rank"]) == [1, 2]


def test_ranks_are_whole_when_all_rows_tie(spark):
    tied = spark.range(2000).selectExpr("1L as doc_id", "5L as score").repartition(7)
    assert sorted(r["rank"] for r in importance.ranked(tied).collect()) == list(range(1, 2001))
