"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts are split without a regex. Every code point is looked up in a class array (letter, number, space, other white space,
other, apostrophe); where no apostrophe can open a contraction the start of a piece follows from neighbouring classes
alone. White space resets the automaton, so only stretches without white space that hold such an apostrophe need the rest:
each character there is a transition function over seven states, and an associative scan (function composition, doubling
strides) gives the state before every character. Slices between starts feed pair merging, whose results are cached.

``encode`` keeps ids and byte offsets; ``decode`` turns ids back into bytes.

Defined cases: a null text is an empty text; an empty text has no ids and decodes to no bytes; very long texts are encoded
whole, their memory in proportion to their own length; repeated rows are encoded each; an empty table gives no rows; extra
columns, whatever their names, are ignored by ``encode`` and kept by ``decode``, which replaces ``decoded`` and ``offsets``.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import resident, small_batches

RANKS = "byte_bpe_multi_50k.tiktoken"
LETTER, NUMBER, SPACE, WHITE, OTHER, QUOTE = range(6)
#: Entries in each of the two generations of a worker's cache of merged slices (results do not depend on it).
CACHE_ENTRIES = 100_000
#: White space in the sense of the Unicode property, as the pattern's \s has it (fixed values).
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: Letters and numbers of Unicode 16.0 that older character data do not know (fixed values).
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

# States of the automaton: nothing open, a space that joins what follows, a run of letters, numbers or others, one or two
# characters of a contraction still to come.
FRESH, JOIN, LETTERS, NUMBERS, OTHERS, ONE_MORE, TWO_MORE = range(7)


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for low, high in ranges:
            table[low : high + 1] = kind
    table[WHITE_SPACE] = WHITE
    table[0x20] = SPACE
    table[0x27] = QUOTE
    return table


def _transitions() -> np.ndarray:
    """``[symbol, state] -> state``; symbols are the classes, then an apostrophe that opens two or three characters."""
    out = np.empty((8, 7), np.uint8)
    out[LETTER] = [LETTERS, LETTERS, LETTERS, LETTERS, LETTERS, FRESH, ONE_MORE]
    out[NUMBER] = NUMBERS
    out[SPACE] = JOIN
    out[WHITE] = FRESH
    out[OTHER] = out[QUOTE] = OTHERS
    out[6] = [ONE_MORE, OTHERS, ONE_MORE, ONE_MORE, OTHERS, ONE_MORE, ONE_MORE]
    out[7] = [TWO_MORE, OTHERS, TWO_MORE, TWO_MORE, OTHERS, TWO_MORE, TWO_MORE]
    return out


TRANSITIONS = _transitions()
#: ``[symbol, state before] -> a piece starts here``, for characters that are not white space.
STARTS = np.array(
    [
        [1, 0, 0, 1, 1, 0, 0],
        [1, 0, 1, 0, 1, 1, 1],
        [1] * 7,
        [1] * 7,
        [1, 0, 1, 1, 0, 1, 1],
        [1, 0, 1, 1, 0, 1, 1],
        [1, 0, 1, 1, 0, 1, 1],
        [1, 0, 1, 1, 0, 1, 1],
    ],
    bool,
)


def scan_states(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The state before each symbol, all stretches at once.

    ``first`` marks where a stretch begins; the function there is replaced by the constant FRESH, so that composition
    never reaches over it. Doubling strides compose the functions: after k rounds each covers 2**k symbols.
    """
    n = len(symbols)
    funcs = np.empty((n, 7), np.uint8)
    funcs[0] = FRESH
    funcs[1:] = TRANSITIONS[symbols[:-1]]
    funcs[first] = FRESH
    stride = 1
    while stride < n:
        ahead = np.take_along_axis(funcs[stride:], funcs[:-stride].astype(np.intp), axis=1)
        if np.array_equal(ahead, funcs[stride:]):
            break  # every function is constant now
        funcs[stride:] = ahead
        stride *= 2
    return funcs[:, FRESH]


def piece_starts(points: np.ndarray) -> np.ndarray:
    """True where a piece starts, for the code points of one text."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = class_table()[points]
    white = (kind == SPACE) | (kind == WHITE)
    prior = np.empty(n, np.uint8)
    prior[0], prior[1:] = WHITE, kind[:-1]
    prior_white = np.empty(n, bool)
    prior_white[0], prior_white[1:] = False, white[:-1]
    last_white = np.zeros(n, bool)  # white space right before something else: joined to it, or a piece of its own
    last_white[:-1] = white[:-1] & ~white[1:]
    kin = np.where(kind == QUOTE, OTHER, kind)
    prior_kin = np.where(prior == QUOTE, OTHER, prior)
    starts = np.where(white, last_white | ~prior_white, (kin != prior_kin) & (prior != SPACE))
    starts[0] = True
    opens = np.flatnonzero(kind == QUOTE)
    if len(opens):
        starts = _with_contractions(points, kind, white, starts, opens)
    return starts


def _with_contractions(points: np.ndarray, kind: np.ndarray, white: np.ndarray, starts: np.ndarray, opens: np.ndarray) -> np.ndarray:
    padded = np.concatenate([points, [0, 0]])
    a, b = padded[opens + 1], padded[opens + 2]
    short = np.isin(a, [115, 116, 109, 100])  # s t m d
    long = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))  # re ve ll
    opens, short = opens[short | long], short[short | long]
    if not len(opens):
        return starts
    symbols = kind.copy()
    symbols[opens] = np.where(short, 6, 7)
    # stretches of other than white space, with the white space before them, that hold an opening apostrophe
    stretch = np.cumsum(white)
    held = np.zeros(int(stretch[-1]) + 1, bool)
    held[stretch[opens]] = True
    where = np.flatnonzero(held[stretch])
    first = np.empty(len(where), bool)
    first[0], first[1:] = True, np.diff(stretch[where]) != 0
    states = scan_states(symbols[where], first)
    again = ~white[where]
    starts[where[again]] = STARTS[symbols[where[again]], states[again]]
    return starts


class Codec:
    """Ranks of a vocabulary, the cache of merged slices, and both directions."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.widths = np.zeros(max(self.tokens, default=0) + 1, np.int64)
        for rank, token in self.tokens.items():
            self.widths[rank] = len(token)
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.older: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one slice: the pair of least rank, the leftmost of equals, is joined until none is left."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        if len(piece) > 200:
            return _merge_long(piece, ranks)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        costs = [ranks.get(parts[i] + parts[i + 1], _NONE) for i in range(len(parts) - 1)]
        while costs:
            low = min(costs)
            if low == _NONE:
                break
            i = costs.index(low)
            parts[i] += parts.pop(i + 1)
            costs.pop(i)
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
        return tuple([ranks[p] for p in parts])

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and for each the byte at which it starts."""
        if not text:
            return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        raw = text.encode("utf-8", "surrogatepass")
        starts = np.flatnonzero(piece_starts(points))
        if len(raw) != len(points):  # from characters to bytes
            widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            starts = (np.cumsum(widths) - widths)[starts]
        edges = starts.tolist()
        slices = [raw[a:b] for a, b in zip(edges, [*edges[1:], len(raw)])]
        cache = self.cache
        found = [cache.get(s) for s in slices]
        if None in found:
            if len(cache) > CACHE_ENTRIES:  # what is used again moves over from the older generation
                self.older, self.cache = cache, {}
                cache = self.cache
            older = self.older
            for k, ids in enumerate(found):
                if ids is None:
                    s = slices[k]
                    ids = cache.get(s)
                    if ids is None:
                        ids = older.get(s) or self.merge(s)
                        if len(s) <= 64:
                            cache[s] = ids
                    found[k] = ids
        ids = np.array([i for some in found for i in some], np.uint32)
        ends = np.cumsum(self.widths[ids])
        return ids, np.concatenate([[0], ends[:-1]]).astype(np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_NONE = 1 << 60


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same merges over a linked list with a heap, for very long slices: n log n instead of n squared."""
    import heapq

    n = len(piece)
    size = [1] * n
    ahead, behind = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(ranks[p], i, 1, 1) for i in range(n - 1) if (p := piece[i : i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = ahead[i] if size[i] == left else -1
        if j < 0 or size[j] != right:
            continue
        size[i] += size[j]
        size[j] = 0
        ahead[i] = ahead[j]
        if ahead[i] >= 0:
            behind[ahead[i]] = i
        for a, b in ((behind[i], i), (i, ahead[i])):
            if a >= 0 and b >= 0 and (p := piece[a : a + size[a] + size[b]]) in ranks:
                heapq.heappush(heap, (ranks[p], a, size[a], size[b]))
    out, i = [], 0
    while i >= 0:
        out.append(ranks[piece[i : i + size[i]]])
        i = ahead[i]
    return tuple(out)


def codec(path: str) -> Codec:
    """The codec of this Python worker."""
    return resident(("bpe", path), lambda: Codec(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def encode(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None, decoded: bool = False) -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids`` and ``offsets`` of every text.

    ``ids`` and ``offsets`` are binary columns of little-endian unsigned 32-bit integers: the ids, and the byte at which
    each token starts in the text's UTF-8. With ``decoded`` the stored ids are read back in the same worker and a column
    ``decoded`` has the bytes they stand for. The vocabulary file must be readable on every executor.
    """
    small_batches(df.sparkSession)
    path = path or default_path()
    names = [id_col, "n_tokens", "ids", "offsets", *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            counts, ids, offsets = [], [], []
            for text in batch.column(1):
                found, at = own.encode(text.as_py())
                counts.append(len(found))
                ids.append(found.astype("<u4").tobytes())
                offsets.append(at.astype("<u4").tobytes())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(offsets, pa.binary())]
            if decoded:
                columns.append(pa.array([own.decode(np.frombuffer(x, "<u4")) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, n_tokens long, ids binary, offsets binary" + ", decoded binary" * decoded)


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with ``decoded`` (binary) in place of ``ids_col``'s offsets: the bytes the ids stand for."""
    small_batches(df.sparkSession)
    path = path or default_path()
    rest = [c for c in df.columns if c not in ("offsets", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            raw = [own.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(batch.schema.get_field_index(ids_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*rest, "decoded"])

    src = df.select(*rest)
    return src.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema], "decoded binary"]))


def digests(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """Each text encoded and its ids decoded again: counts and digests of both."""
    coded = encode(df, text_col, id_col, path, decoded=True)
    return coded.select(F.col(id_col), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
