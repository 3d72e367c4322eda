"""SimHash and decontamination against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import simhash, spaced_seeds

SCHEMA = "doc_id long, text string, fp string, score double, mask int, key long, component_id long, tokens string, region int, item_id int"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 0.5, 1, 2, 3, "y", 4, 5) for i, t in rows], SCHEMA)


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def classes(values):
    """Least index of each component of values within three bits."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints_and_components(spark):
    rnd = random.Random(1)
    words = [f"w{k}é" if k % 5 else f"W{k}" for k in range(300)]
    rows = []
    for i in range(40):
        base = [rnd.choice(words) for _ in range(rnd.randint(60, 200))]
        rows.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = "changed"
            rows.append("\n".join(copy))
    rows += ["", None, " \t ", "one", "ONE", "two words", "a b c", "x" * 300_000, "word " * 70_000]
    frame = docs(spark, list(enumerate(rows))).union(docs(spark, [(3, rows[3]), (None, "one"), (None, None)]))
    got = simhash.near_duplicates(frame).collect()
    fp_of = {rows[r.doc_id]: r.fp for r in got if r.doc_id is not None}
    assert len(got) == len(rows) + 3
    prints = [slow_fingerprint(t) for t in rows]
    want = classes(prints)
    for row in got:
        if row.doc_id is None:  # links like any other: to the component of equal texts here
            assert row.component_id == want[rows.index("one" if row.fp == fp_of["one"] else None)]
        else:
            assert row.fp & (1 << 64) - 1 == prints[row.doc_id]
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == dict(enumerate(want))
    assert len(set(want)) < len(rows) - 20


def test_rows_without_ids_carry_links(spark, monkeypatch):
    """Two documents are joined through one that has no id; rows without ids alone have no component."""
    texts = {"a": 0x000000, "b": 0x000007, "c": 0x00003F, "d": 0xFFFF << 40}
    monkeypatch.setattr(simhash, "fingerprints", lambda df, i, t: df.select(i, F.element_at(F.create_map(*[F.lit(x) for p in texts.items() for x in p]), F.col(t)).cast("long").alias("fp")))
    frame = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (None, "d")], "doc_id long, text string")
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(frame).collect()}
    assert got == {(1, 0): 1, (None, 7): 1, (2, 63): 1, (None, 0xFFFF << 40): None}



@pytest.mark.parametrize("split_at", [2000, 4])
def test_dense_buckets_lose_no_link(spark, split_at):
    rng = np.random.default_rng(3)
    values = set()
    for b in rng.integers(0, 2**63, 6, dtype=np.uint64).tolist():
        x = b
        for _ in range(50):
            y = x
            for _ in range(int(rng.integers(1, 4))):
                y ^= 1 << int(rng.integers(0, 64))
            values.add(y)
            x = y if rng.random() < 0.5 else b
    values = np.array(sorted(values), np.uint64)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, split_at=split_at)).collect()}
    found = [roots.get(v, v) for v in values.view(np.int64).tolist()]
    want = classes(values.tolist())
    assert len(set(zip(found, want))) == len(set(found)) == len(set(want))


def test_pivot_filter_keeps_every_close_pair():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (30, 20)).astype(np.uint64)
    fps = np.unique((base[:, None] ^ flips).ravel())
    found = {tuple(sorted((int(a), int(b)))) for i, j in simhash.linked_pairs(fps, step=64) for a, b in zip(i, j)}
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    assert found == {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}


@pytest.mark.parametrize("split_at", [2000, 8])
def test_similar_groups_against_brute_force(spark, split_at):
    """Chains and families of near copies, buckets in one part and in many: components are those of all pairs."""
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for i in range(25):
        text = [rnd.choice(words) for _ in range(rnd.randint(40, 160))]
        for _ in range(rnd.choice([1, 1, 3, 12])):
            rows.append(" ".join(text))
            copy = list(text)
            for _ in range(rnd.choice([0, 1, 2])):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append(" ".join(copy).upper())
            text = copy if rnd.random() < 0.4 else text
    rows += ["", None, "\t", "one two", "ONE  two", "one two three", "x" * 200_000, "na " * 60_000]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(rows)], "doc_id long, text string, node int, row int")
    got = {r.doc_id: r.component for r in simhash.similar_groups(frame, "doc_id", split_at=split_at).collect()}
    sets = []
    for t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = [find(i) for i in range(len(rows))]
    found = [got[i] for i in range(len(rows))]
    assert len(set(zip(found, want))) == len(set(found)) == len(set(want)) < len(rows) - 40
    assert simhash.similar_groups(frame.limit(0), "doc_id").count() == 0


def test_links_behind_nearer_rows_that_do_not_link(spark, monkeypatch):
    """Every fingerprint lies at the same distance and the nearest rows (the first in order) do not link: all others are tried too."""
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    base = [rnd.choice(words) for _ in range(200)]
    rows = []
    for i in range(40):  # pairs of near copies that share 100 of 200 words with all others
        text = base[:100] + [rnd.choice(words) for _ in range(100)]
        rows += [" ".join(text), " ".join([*text[:-1], "last"])]
    monkeypatch.setattr(simhash, "band_keys", lambda hashes: np.zeros(1, np.uint64))
    monkeypatch.setattr(simhash, "wide_fingerprint", lambda hashes: np.zeros(simhash.WIDE, np.uint64))
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component for r in simhash.similar_groups(frame, "doc_id").collect()}
    assert len(set(got.values())) == 40 and all(got[i] == got[i + 1] for i in range(0, 80, 2))


def test_pairs_of_a_large_group_are_never_rows(spark, monkeypatch):
    """120 texts in one bucket share half their words, and every third has a near copy: links are found, tables grow with the texts."""
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(3000)]
    base = [rnd.choice(words) for _ in range(100)]
    rows = []
    for i in range(90):
        text = base + [rnd.choice(words) for _ in range(100)]
        rows += [" ".join(text), " ".join([*text[:-1], "last"])][: 1 + (i % 3 == 0)]
    monkeypatch.setattr(simhash, "band_keys", lambda hashes: np.zeros(1, np.uint64))
    monkeypatch.setattr(simhash, "wide_fingerprint", lambda hashes: np.zeros(simhash.WIDE, np.uint64))
    written = []
    keep = simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df, *rest: written.append(keep(df, *rest)) or written[-1])
    monkeypatch.setattr(simhash, "discard", lambda *tables: None)
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component for r in simhash.similar_groups(frame, "doc_id").collect()}
    assert len(rows) == 120 and len(set(got.values())) == 90
    assert max(t.count() for t in written) <= 2 * len(rows)


@pytest.mark.parametrize("limit", [simhash.SPLIT_AT, 5])
def test_exact_links_against_all_pairs(limit):
    """Sets of unlike sizes, one empty: the links join what all pairs join, and are fewer than the sets."""
    rng = np.random.default_rng(limit)
    base = np.unique(rng.integers(1, 2**60, 60))
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(40, len(base)), replace=False), rng.integers(1, 2**60, rng.integers(0, 12))])) for _ in range(70)]
    sets = sets[:limit] + [np.zeros(0, np.int64)]
    roots = np.arange(len(sets))
    roots[1] = roots[0]
    found = simhash.exact_links(np.zeros((len(sets), simhash.WIDE), np.uint64), roots, sets, 0.8)

    def joined(pairs):
        component = roots.copy()
        for i, j in pairs:
            component[component == component[j]] = component[i]
        return {frozenset(np.flatnonzero(component == c).tolist()) for c in component}

    alike = [(i, j) for i in range(len(sets)) for j in range(i) if (c := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - c)]
    assert joined(found) == joined(alike) and len(found) < len(sets) and set(map(frozenset, found)) <= set(map(frozenset, alike))


def test_nearest_outside_keeps_every_near_row():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, (6, simhash.WIDE), dtype=np.uint64)
    words = np.repeat(base, 20, axis=0)
    words[:, 0] ^= np.uint64(1) << rng.integers(0, 60, 120).astype(np.uint64)
    roots = rng.integers(0, 50, 120)
    i, j = simhash.nearest_outside(words, roots, step=32)
    apart = np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2)
    apart = np.where(roots[:, None] == roots[None], 999, apart)
    assert set(i.tolist()) == set(np.flatnonzero(apart.min(axis=1) <= simhash.WIDE_RADIUS).tolist())
    assert (apart[i, j] == apart.min(axis=1)[i]).all()


def test_empty_tables(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    items = spark.createDataFrame([], "item_id int, text string")
    assert spaced_seeds.contaminated(docs(spark, [(1, "a b c d e f")]), items).count() == 0
    assert spaced_seeds.contaminated(docs(spark, []), spark.createDataFrame([(1, "a b c d e f")], "item_id int, text string")).count() == 0


def slow_overlap(doc, item):
    """Best share of an item's tokens (of a segment, if long) that agree at some alignment."""
    a, b = (re.findall(r"\w+", (t or "").lower()) for t in (doc, item))
    best = 0.0
    for lo, hi in spaced_seeds.segments(len(b)):
        part = b[lo:hi]
        if part:
            for shift in range(-len(part) + 1, len(a)):
                best = max(best, sum(1 for k, w in enumerate(part) if 0 <= k + shift < len(a) and a[k + shift] == w) / len(part))
    return best


def test_decontamination_against_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(400)] + ["the", "of", "and"] * 20
    items = [" ".join(rnd.choice(words) for _ in range(n)) for n in (5, 8, 15, 30, 45, 64, 65, 150)] + ["", None, "quite short item", "na " * 20, "word", "w7 w8"]
    rows = []
    for i in range(120):
        text = [rnd.choice(words) for _ in range(rnd.randint(0, 200))]
        if i % 2:
            part = re.findall(r"\w+", rnd.choice(items[:8]))
            for _ in range(rnd.choice([0, 1, len(part) // 8])):
                part[rnd.randrange(len(part))] = "other"
            at = rnd.randint(0, len(text))
            text[at:at] = [w.upper() + "," for w in part]
        rows.append(" ".join(text))
    rows += ["", None, items[3] + " " + items[4], "na " * 50, "A quite short, item", "WORD", "x w7 w8 y", "filler " * 40_000 + items[2]]
    frame = docs(spark, list(enumerate(rows))).union(docs(spark, [(0, items[5]), (None, items[3])]))
    table = spark.createDataFrame(list(enumerate(items)), "item_id int, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id): r.similarity for r in spaced_seeds.contaminated(frame, table).collect()}
    want = {}
    for i, t in [*((i, t) for i, t in enumerate(rows) if len(t or "") < 20_000), (0, items[5]), (None, items[3])]:
        for k, item in enumerate(items):
            s = slow_overlap(t, item)
            if s >= 0.8:
                want[(i, k)] = max(s, want.get((i, k), 0))
    want[(len(rows) - 1, 2)] = 1.0
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(want[k], 9) for k in got}
    assert set(want) == set(got)


def test_masks_find_spread_substitutions():
    rnd = random.Random(8)
    found = 0
    for _ in range(300):
        item = np.array([rnd.randrange(2**32) for _ in range(30)], np.uint64)
        copy = item.copy()
        copy[rnd.sample(range(30), 6)] += np.uint64(1)  # 80 per cent left
        found += any((a == b).any() for a, b in zip(spaced_seeds.seed_hashes(item), spaced_seeds.seed_hashes(copy)))
    assert found >= 295
