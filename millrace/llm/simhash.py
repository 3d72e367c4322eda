"""SimHash near-duplicates: fingerprints linked at a small Hamming distance, candidates cut by pivot distance tables.

Plan
----
1. Every text becomes one 64-bit fingerprint (Arrow batches; whole text).
2. Equal fingerprints are folded (``groupBy`` with map-side partial sums), so a group of copies costs one row from here.
3. Blocks: with at most 3 differing bits, at least 3 of 6 blocks agree, so each fingerprint is put under the 20 keys made
   of 3 of its 6 blocks (about 32 bits each). Keys held by one fingerprint only are dropped.
4. A key with more than ``split_at`` members is dealt again by 3 of 6 parts of the bits it does not fix. Such a bucket
   fixes 48 bits, so it has at most 2**16 different fingerprints whatever the input: no group is unbounded, none is cut.
5. In a bucket, pairs are discarded by the pivot table: each fingerprint carries its Hamming distances to fixed reference
   fingerprints, and by the triangle inequality two within ``radius`` differ by at most ``radius`` in every coordinate.
   Survivors are verified bit by bit; a bucket emits a spanning forest of its links, not all pairs.
6. Links are joined to components by alternating large-star and small-star rounds.

Texts that are similar word by word (``similar_groups``) differ by many more bits than blocks can serve: at a Jaccard similarity
of 0.8 about 39 of 256. There candidates meet under band keys (least values of the same shingle hashes under several orders),
fingerprints are longer, and the pivots are members of the bucket itself, from which its clusters lie at unlike distances.
Survivors are verified by the exact similarity of their shingle sets, inside the bucket: members of several components go to their
bucket with their sets, and a bucket gives the links that join components. Pairs are never rows of a table, so a group of near
copies, or of texts that nearly are, costs rows in proportion to its members, however many pairs are compared.

Defined cases: null text is an empty text; no words give fingerprint zero, which links like any other; a row with a null
id links like any other (its component is null only where no id is reachable); repeated rows give repeated rows; very long texts are read whole;
ties go to the least id; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialise, small_batches, small_side

SEED = 42
SHINGLE = 3
RADIUS = 3
BLOCKS = 6
PIVOTS = 24
SPLIT_AT = 2000
#: ``similar_groups``: words of a shingle, 64-bit words of a fingerprint and the most bits that may differ, bands and values in each.
SIMILAR_SHINGLE, WIDE, WIDE_RADIUS = 5, 4, 64
BANDS, ROWS = 16, 5
#: Pivots taken from a bucket, and shingle hashes in a part of a bucket whose texts are compared (a task holds two parts).
OWN_PIVOTS, HASHES_HELD = 8, 500_000
#: Buckets of at most so many fingerprints are compared together, larger ones one by one.
SMALL_BUCKET = 16
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_digests(text: str | None, shingle: int, step: int = 1 << 16) -> Iterator[bytes]:
    """The XXH64 digests (eight bytes each, big-endian) of all word shingles, repeats included, in blocks: a very long text needs
    little memory. Fewer words are one shingle; a text without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        yield digest(joined, SEED)
        return
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    for k in range(0, len(starts), step):
        yield b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + step], ends[k : k + step])])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 values of all word shingles, repeats included; zero for a text without words."""
    count, total = 0, np.zeros(64, np.int64)
    for raw in shingle_digests(text, shingle):
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        total += _column_sums(bits)
        count += len(bits)
    return int.from_bytes(np.packbits(2 * total > count).tobytes(), "big")


def _column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of 0/1 bytes per column: 255 rows at a time fit in bytes, added eight to a machine word."""
    words = bits.view(np.uint64)
    total = np.zeros(64, np.int64)
    for k in range(0, len(words), 255):
        total += words[k : k + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return total


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id_col`` and ``fp``, the fingerprint as a signed 64-bit long, for every row."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=[id_col, "fp"])

    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    id_type = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {id_type}, fp long")


def pivot_fingerprints(count: int = PIVOTS) -> np.ndarray:
    """The fixed reference fingerprints: XXH64 of their numbers."""
    return np.array([xxhash.xxh64_intdigest(str(k).encode(), SEED) for k in range(count)], np.uint64)


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances, a row for each pivot and a column for each fingerprint."""
    return np.stack([np.bitwise_count(fps ^ p) for p in pivots]).astype(np.int8)


def linked_pairs(fps: np.ndarray, radius: int = RADIUS, pivots: np.ndarray | None = None, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of ``fps`` within ``radius`` bits, each pair once, in blocks of bounded size.

    Rows are sorted by their distance to the first pivot, so a row meets only the window whose first coordinate differs by
    ``radius`` at most; the further coordinates discard more pairs; what is left is compared bit by bit.
    """
    pivots = pivot_fingerprints() if pivots is None else pivots
    table = pivot_table(fps, pivots)
    order = np.argsort(table[0], kind="stable")
    table, sorted_fps = table[:, order], fps[order]
    reach = np.searchsorted(table[0], table[0] + radius, side="right")
    for a in range(0, len(fps), step):
        b = min(a + step, len(fps))
        for c in range(a, int(reach[a:b].max(initial=a)), 8 * step):
            d = min(c + 8 * step, int(reach[a:b].max()))
            i, j = np.nonzero(np.abs(table[0, a:b, None] - table[0, None, c:d]) <= radius)
            i, j = i + a, j + c
            keep = i < j
            i, j = _survivors(sorted_fps, table[1:], i[keep], j[keep], radius)
            if len(i):
                yield order[i], order[j]


def bucket_links(fps: np.ndarray, cuts: np.ndarray, radius: int = RADIUS, pivots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (greater, lesser) of all buckets ``fps[cuts[k]:cuts[k + 1]]``: union-find over the verified pairs."""
    pivots = pivot_fingerprints() if pivots is None else pivots
    sizes = np.diff(cuts)
    group = np.repeat(np.arange(len(sizes)), sizes)
    bits = fps.view(np.uint64)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    few = sizes[group] <= SMALL_BUCKET  # small buckets all at once: each row with the next, the one after, and so on
    table = pivot_table(bits, pivots)
    for step in range(1, min(SMALL_BUCKET, int(sizes.max(initial=0)))):
        i = np.flatnonzero(few[:-step] & (group[:-step] == group[step:]))
        pairs.append(_survivors(bits, table, i, i + step, radius))
    for k in np.flatnonzero(sizes > SMALL_BUCKET):
        pairs += [(i + cuts[k], j + cuts[k]) for i, j in linked_pairs(bits[cuts[k] : cuts[k + 1]], radius, pivots)]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for i, j in pairs:
        for x, y in zip(fps[i].tolist(), fps[j].tolist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = np.array([x for x in list(root) if find(x) != x], np.int64)
    return nodes, np.array([find(x) for x in nodes.tolist()], np.int64)


def _survivors(bits: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs left after every coordinate of the pivot table, verified bit by bit."""
    for row in table:
        keep = np.abs(row[i] - row[j]) <= radius
        i, j = i[keep], j[keep]
    keep = np.bitwise_count(bits[i] ^ bits[j]) <= radius
    return i[keep], j[keep]


def _masks(positions: list[int], blocks: int, chosen: int) -> list[int]:
    """Masks of every choice of ``chosen`` of ``blocks`` equal runs of the given bit positions."""
    cut = [round(k * len(positions) / blocks) for k in range(blocks + 1)]
    runs = [sum(1 << positions[i] for i in range(cut[k], cut[k + 1])) for k in range(blocks)]
    return [sum(runs[k] for k in c) for c in combinations(range(blocks), chosen)]


def _long(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _keys(masks: list[int]) -> Column:
    """An array of (mask number, masked fingerprint), for ``explode``."""
    return F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_long(m)).cast("long")).alias("key")) for k, m in enumerate(masks)])


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, split_at: int = SPLIT_AT, pivots: int = PIVOTS) -> DataFrame:
    """Spanning links (``a`` > ``b``, signed longs) of all fingerprints of ``fps`` (distinct ``fp``) within ``radius`` bits."""
    assert 0 <= radius < blocks
    masks = _masks(list(range(64)), blocks, blocks - radius)
    keyed = fps.select("fp", F.explode(_keys(masks)).alias("k")).select("fp", "k.mask", "k.key")
    held = materialise(keyed.groupBy("mask", "key").agg(F.count("*").alias("members")).where("members > 1"), "simhash-buckets")
    rows = materialise(keyed.join(held, ["mask", "key"]), "simhash-members")
    dense = rows.where(F.col("members") > split_at)
    free = [[p for p in range(64) if not m >> p & 1] for m in masks]
    finer = [_masks(f, blocks, blocks - radius) for f in free]
    again = reduce(  # the bits a mask leaves free are dealt once more; each mask has its own
        lambda whens, k: whens.when(F.col("mask") == k, F.array(*[F.struct(F.lit(1000 * (k + 1) + n).alias("sub"), F.col("fp").bitwiseAND(F.lit(_long(m | masks[k])).cast("long")).alias("subkey")) for n, m in enumerate(finer[k])])),
        range(1, len(masks)),
        F.when(F.col("mask") == 0, F.array(*[F.struct(F.lit(1000 + n).alias("sub"), F.col("fp").bitwiseAND(F.lit(_long(m | masks[0])).cast("long")).alias("subkey")) for n, m in enumerate(finer[0])])),
    )
    dense = dense.select("fp", F.explode(again).alias("k")).select("fp", F.col("k.sub").alias("mask"), F.col("k.subkey").alias("key"))
    dealt = rows.where(F.col("members") <= split_at).select("fp", "mask", "key").unionByName(dense)
    reference = pivot_fingerprints(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((3, 0), np.int64)  # the bucket that the last batch may not have ended; at most 2**16 rows
        for batch in _and_end(batches):
            if batch is not None:
                rest = np.concatenate([rest, np.stack([np.asarray(c, np.int64) for c in batch.columns])], axis=1)
            new = np.flatnonzero((np.diff(rest[:2], axis=1) != 0).any(axis=0)) + 1
            cut = rest.shape[1] if batch is None else (int(new[-1]) if len(new) else 0)
            if cut:
                a, b = bucket_links(rest[2, :cut], np.concatenate([[0], new[new < cut], [cut]]), radius, reference)
                rest = rest[:, cut:]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    members = rows.count()
    ordered = dealt.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").select(F.col("mask").cast("long"), "key", "fp")
    return materialise(ordered.mapInArrow(run, "a long, b long").distinct(), "simhash-links", members)


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) of every node of ``edges`` (``a``, ``b``).

    Alternating stars: a large star hangs every greater neighbour of a node on the least node it sees; a small star hangs
    the lesser neighbours on the least. Rounds are written out, so no lineage grows; they end when nothing changes.
    """
    size = edges.count()
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars", size)

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()

    def least(df: DataFrame, rows: int) -> DataFrame:
        return materialise(df.groupBy("a").agg(F.min("b").alias("m")), "star-least", rows)

    before = state(now)
    for _ in range(max_rounds):
        size, last = before[0], now
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seen = least(both, 2 * size)
        low = seen.withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b").distinct(), "large-star", size)
        low = least(large, size)
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        now = materialise(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "small-star", 2 * size)
        after = state(now)
        discard(last, seen, large, low)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return materialise(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), "star-roots", 2 * before[0])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, split_at: int = SPLIT_AT) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` (the least id reachable over links of ``radius`` bits) of every row of ``df``."""
    rows = materialise(fingerprints(df, id_col, text_col), "simhash-fingerprints")
    least = materialise(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    roots = components(links(least.select("fp"), radius, split_at=split_at))
    linked = roots.count()
    tied = roots.join(least.withColumnRenamed("fp", "node"), "node")
    top = materialise(tied.groupBy("root").agg(F.min("least").alias("top")), "simhash-tops", linked)
    of_node = roots.join(top, "root").select(F.col("node").alias("fp"), "top")
    named = least.join(of_node, "fp", "left").select("fp", F.coalesce("top", "least").alias("component_id"))
    named = materialise(named, "simhash-named")
    return rows.join(named, "fp", "left").select(id_col, "fp", "component_id")


_MIX = (np.random.default_rng(23).integers(1, 2**62, 2 * WIDE + BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_set(text: str | None, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(np.frombuffer(b"".join(shingle_digests(text, shingle)), ">u8").astype(np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WIDE`` words of majority bits over a shingle set; each word mixes the hashes anew."""
    out = np.zeros(WIDE, np.uint64)
    for w in range(WIDE if len(hashes) else 0):
        total = np.zeros(64, np.int64)
        for k in range(0, len(hashes), 1 << 16):
            mixed = (hashes[k : k + (1 << 16)] + _MIX[w]) * _MIX[WIDE + w]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[w]
            mixed ^= mixed >> np.uint64(32)
            total += _column_sums(np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1))
        out[w] = np.packbits(2 * total > len(hashes)).view(np.uint64)[0]
    return out


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: its ``ROWS`` least values of the set, each under an order of its own, as one hash."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 1 << 12):
        part = hashes[k : k + (1 << 12), None] * _MIX[2 * WIDE :]
        np.minimum(low, part.min(axis=0), out=low)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, ROWS))], np.uint64)


def sketches(df: DataFrame, key_col: str, text_col: str, shingle: int) -> DataFrame:
    """``row`` (the key), ``node`` (a digest of the shingle set), its ``size``, ``f`` (the long fingerprint) and ``bands`` of every row."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), shingle) for x in batch.column(1)]
            nodes = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64)
            lists = [pa.array([f(x).view(np.int64) for x in sets], pa.list_(pa.int64())) for f in (wide_fingerprint, band_keys)]
            sizes = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes.view(np.int64)), sizes, *lists], names=["row", "node", "size", "f", "bands"])

    src = df.select(F.col(key_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"row {src.schema[0].dataType.simpleString()}, node long, size long, f array<long>, bands array<long>")


def pairs_outside(words: np.ndarray, roots: np.ndarray, radius: int = WIDE_RADIUS, step: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs (both ways) of rows of ``words`` (long fingerprints) of different roots within ``radius`` bits, with the bits by which
    they differ, in blocks of ``step`` first rows.

    Pivots are rows of the bucket: pairs whose distances to one of them differ by more than ``radius`` are discarded.
    """
    n = len(words)
    pivots = words[np.unique(np.linspace(0, n - 1, OWN_PIVOTS).astype(int))]
    table = np.stack([np.bitwise_count(words ^ p).sum(axis=1, dtype=np.int16) for p in pivots])
    for a in range(0, n, step):
        b = min(a + step, n)
        near = roots[a:b, None] != roots[None]
        for row in table:
            near &= np.abs(row[a:b, None] - row[None]) <= radius
        i, j = np.nonzero(near)
        apart = np.bitwise_count(words[i + a] ^ words[j]).sum(axis=1, dtype=np.int16)
        keep = apart <= radius
        yield i[keep] + a, j[keep], apart[keep]


def nearest_outside(words: np.ndarray, roots: np.ndarray, radius: int = WIDE_RADIUS, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``words`` the nearest row of another root within ``radius`` bits, as index pairs."""
    found_i, found_j = [], []
    for i, j, apart in pairs_outside(words, roots, radius, step):
        order = np.lexsort((j, apart, i))
        first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
        found_i.append(i[first])
        found_j.append(j[first])
    return np.concatenate(found_i), np.concatenate(found_j)


def exact_links(words: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Index pairs of rows whose sets have the Jaccard similarity or more: enough of them to join all components (``roots``) that a pair
    within ``WIDE_RADIUS`` bits joins, one less than there are rows at most. Rows that links already join are not compared."""
    component = np.unique(roots, return_inverse=True)[1]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    distinct, tokens = np.unique(np.concatenate([*sets, np.zeros(1, np.int64)]), return_inverse=True)  # one more: an empty set may be the last
    tokens = tokens.astype(np.int32)
    own = np.zeros(len(distinct), bool)
    found: list[tuple[int, int]] = []
    for i, j, _ in pairs_outside(words, component):  # which reads ``component`` anew for each block
        total, least = sizes[i] + sizes[j], np.minimum(sizes[i], sizes[j])
        keep = (i < j) & (least >= similarity * (total - least))
        i, j = i[keep], j[keep]
        first = np.flatnonzero(np.diff(i, prepend=-1)).tolist()
        for a, b in zip(first, [*first[1:], len(i)]):
            x, others = int(i[a]), j[a:b]
            others = others[component[others] != component[x]]
            if not len(others):
                continue
            mine = tokens[starts[x] : starts[x] + sizes[x]]
            own[mine] = True
            if 4 * len(others) < len(sets):
                common = np.array([np.count_nonzero(own[tokens[starts[y] : starts[y] + sizes[y]]]) for y in others.tolist()])
            else:
                common = np.add.reduceat(own[tokens], starts, dtype=np.int64)[others]
            own[mine] = False
            for y in others[common >= similarity * (sizes[x] + sizes[others] - common)].tolist():
                if component[x] != component[y]:
                    component[component == component[y]] = component[x]
                    found.append((x, y))
    return found


def _with_outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key`` and ``node`` of the rows (``key``, ``cell``, ``node``, ``root``, fingerprint) that have one of another root near them in their cell."""
    rest = np.zeros((4 + WIDE, 0), np.int64)  # of the cell that the last batch may not have ended
    for batch in _and_end(batches):
        if batch is not None:
            rest = np.concatenate([rest, np.stack([np.asarray(c, np.int64) for c in batch.columns])], axis=1)
        new = np.flatnonzero((np.diff(rest[:2], axis=1) != 0).any(axis=0)) + 1
        cut = rest.shape[1] if batch is None else (int(new[-1]) if len(new) else 0)
        cuts = [0, *new[new < cut].tolist(), cut]
        found = []
        for a, b in zip(cuts, cuts[1:]):
            root = rest[3, a:b]
            if b > a and (root != root[0]).any():
                found.append(nearest_outside(np.ascontiguousarray(rest[4:, a:b].T).view(np.uint64), root)[0] + a)
        if found:
            at = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(rest[0, at]), pa.array(rest[2, at])], names=["key", "node"])
        rest = rest[:, cut:]


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell (equal first two columns) of batches that come in their order."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        cells = np.stack([np.asarray(c, np.int64) for c in batch.columns[:2]])
        cuts = [0, *(np.flatnonzero((np.diff(cells, axis=1) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                now = tuple(cells[:, a].tolist())
                if held and now != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = now
    if held:
        yield pa.Table.from_batches(held)


def _dealt(rows: DataFrame, parts: Column) -> DataFrame:
    """``rows`` (``key``, ``node`` and more) with the ``cell`` of their bucket where they meet others: a bucket of several ``parts`` is
    dealt as pairs of parts."""
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.least(k, own).cast("long") * 1_000_000 + F.greatest(k, own))
    counted = rows.withColumn("parts", parts.cast("int"))
    whole = counted.where("parts = 1").withColumn("cell", F.lit(0).cast("long"))
    return whole.unionByName(counted.where("parts > 1").withColumn("cell", F.explode(cells))).drop("parts")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links of ``pairs`` (``a``, ``b``: nodes) whose shingle sets have the Jaccard similarity or more."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    sized = both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("total"))
    return sized.where(F.col("common") >= similarity * (F.col("total") - F.col("common"))).select("a", "b")


def _sets(df: DataFrame, nodes: DataFrame, pairs: DataFrame, key_col: str, text_col: str, shingle: int) -> DataFrame:
    """``node`` and ``hashes`` (the shingle set) of the nodes in ``pairs``, from the text of one row of each."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialise(needed.join(nodes.select("node", "row"), "node"), "similar-wanted")
    src = df.select(F.col(key_col).alias("row"), F.col(text_col).cast("string").alias("text")).join(small_side(wanted), "row").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shingle_set(x.as_py(), shingle).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.int64()))], names=["node", "hashes"])

    return materialise(src.mapInArrow(run, "node long, hashes array<long>"), "similar-sets")


def similar_groups(df: DataFrame, key_col: str, text_col: str = "text", shingle: int = SIMILAR_SHINGLE, similarity: float = 0.8, split_at: int = SPLIT_AT) -> DataFrame:
    """``key_col`` and ``component`` of every row of ``df``: rows whose shingle sets reach ``similarity`` share a component.

    ``key_col`` tells rows apart and has no nulls; ``df`` is a stored table, since some texts are read again. Rows of equal sets
    are one node. Each node of a bucket (a band key) is compared with the bucket's least node; where components remain apart in a
    bucket, every node that has one outside its own component within ``WIDE_RADIUS`` bits is compared with all of those, in tasks
    that hold their sets, so that no candidate of a bucket is left out. Buckets of more than ``split_at`` nodes, or of more than
    ``HASHES_HELD`` shingles, are dealt as pairs of parts. Two texts of similarity s meet in a bucket with probability 1 - (1 - s**5)**16.
    """
    rows = materialise(sketches(df, key_col, text_col, shingle), "similar-sketches")
    nodes = rows.groupBy("node").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("f").alias("f"), F.first("bands").alias("bands"))
    nodes = materialise(nodes, "similar-nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    held = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("lead")).where("members > 1")
    members = materialise(keyed.join(held, "key"), "similar-members")
    prints = nodes.select("node", "f")
    words = [F.col("f")[k].alias(f"f{k}") for k in range(WIDE)]
    near = reduce(lambda x, y: x + y, [F.bit_count(F.col("fa")[k].bitwiseXOR(F.col("fb")[k])) for k in range(WIDE)]) <= WIDE_RADIUS
    stars = members.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    stars = stars.join(prints.select(F.col("node").alias("a"), F.col("f").alias("fa")), "a").join(prints.select(F.col("node").alias("b"), F.col("f").alias("fb")), "b")
    pairs = materialise(stars.where(near).select("a", "b"), "similar-pairs")
    edges = materialise(_verified(pairs, _sets(df, nodes, pairs, key_col, text_col, shingle), similarity), "similar-links")
    roots = components(edges)
    placed = members.join(roots, "node", "left").select("key", "members", "node", F.coalesce("root", "node").alias("root"))
    open_keys = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    open_rows = materialise(placed.join(open_keys, "key", "left_semi").join(prints, "node"), "similar-open")
    ordered = _dealt(open_rows, F.ceil(F.col("members") / split_at)).repartition("key", "cell").sortWithinPartitions("key", "cell", "node")
    near_keys = materialise(ordered.select("key", "cell", "node", "root", *words).mapInArrow(_with_outside, "key long, node long").distinct(), "similar-near")
    sets = _sets(df, nodes, near_keys.select(F.col("node").alias("a"), F.col("node").alias("b")), key_col, text_col, shingle)
    near_rows = open_rows.drop("members").join(near_keys, ["key", "node"]).join(nodes.select("node", "size"), "node")
    weights = near_rows.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / split_at, F.sum("size") / HASHES_HELD)).alias("parts"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _by_cell(batches):
            node, root = (cell.column(c).to_numpy() for c in ("node", "root"))
            hashes = [x.values.to_numpy() for chunk in cell.column("hashes").chunks for x in chunk]
            prints = np.stack([cell.column(f"f{k}").to_numpy() for k in range(WIDE)], axis=1).view(np.uint64)
            found = exact_links(prints, root, hashes, similarity)
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[i], node[j])), pa.array(np.minimum(node[i], node[j]))], names=["a", "b"])

    dealt = _dealt(near_rows.join(weights, "key"), F.greatest(F.col("parts"), F.lit(1))).join(sets, "node")
    ordered = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell", "node").select("key", "cell", "node", "root", *words, "hashes")
    more = materialise(ordered.mapInArrow(compare, "a long, b long").distinct(), "similar-links")
    discard(open_rows, near_keys, sets)
    if more.limit(1).count():
        roots = components(edges.unionByName(more))
    placed = rows.select(F.col("row").alias(key_col), "node").join(roots, "node", "left")
    return placed.select(key_col, F.coalesce("root", "node").alias("component"))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
