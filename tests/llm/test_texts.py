"""BPE, language ID, media and archives: exact round trips and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import archives, bpe, langid, media
from millrace.llm.common import new_path

ODD = ["", None, "a", " ", "\n\n a", "don't we'll I'VE 'tis ''s", "x" * 5000, "日本語テキスト 123", "\U0001f600 é ü z", "word " * 50_000, "a\x00b", "  lead", "trail  "]
EXTRA = "doc_id long, text string, ids string, offsets string, decoded string, media string, payload string, n_tokens int, lang string, score double, raw int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x", 1, "zz", 0.1, 7) for i, t in enumerate(texts)], EXTRA)


@pytest.fixture(scope="module")
def reference():
    codec = bpe.codec(bpe.default_path())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_bpe_equals_the_library(spark, reference):
    rnd = random.Random(1)
    alphabet = "aab  's'st're've'm'll'd''\n\t\r 1½é中!.,x  'l'v'r  "
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    coded = bpe.encode(docs(spark, texts)).collect()
    for row in coded:
        text = texts[row.doc_id] or ""
        ids = np.frombuffer(row.ids, "<u4").tolist()
        assert ids == reference.encode_ordinary(text)
        ends = np.cumsum([len(reference.decode_single_token_bytes(i)) for i in ids])
        assert np.frombuffer(row.offsets, "<u4").tolist() == [0, *ends[:-1]][: len(ids)]
    for row in bpe.digests(docs(spark, texts)).collect():
        raw = (texts[row.doc_id] or "").encode()
        ids = reference.encode_ordinary(texts[row.doc_id] or "")
        assert row.n_tokens == len(ids) and row.decoded_sha256 == hashlib.sha256(raw).hexdigest()
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.digests(docs(spark, [])).count() == 0


def test_code_point_classes(reference):
    codec = bpe.codec(bpe.default_path())
    for block in range(0, 0x110000, 61):
        points = [c for c in range(block, min(block + 61, 0x110000)) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{chr(c)}a1{chr(c)}1!{chr(c)}! {chr(c)}" for c in points)
        assert codec.encode(text)[0].tolist() == reference.encode_ordinary(text), hex(block)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'strevmld \n1é!"), max_size=60))
def test_scan_equals_one_pass(text):
    """The associative scan gives what walking through the automaton gives."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    symbols = bpe.class_table()[points] if len(points) else np.zeros(0, np.uint8)
    if not len(symbols):
        return
    state, want = bpe.FRESH, []
    for s in symbols:
        want.append(state)
        state = bpe.TRANSITIONS[s][state]
    first = np.zeros(len(symbols), bool)
    first[0] = True
    assert bpe.scan_states(symbols, first).tolist() == want


def test_language_forward_algorithm():
    """Against the sum over all segmentations, written out."""
    rng = np.random.default_rng(0)
    size = langid._processor(langid.default_path()).get_piece_size()
    probs = rng.random((size, 3))
    model = langid.Model(["a", "b", "c"], np.zeros(3), probs / probs.sum(axis=0), langid.default_path())
    scorer = langid.Scorer(model)

    def total(s):
        if not s:
            return np.ones(3)
        out = np.zeros(3)
        for k in range(1, len(s) + 1):
            p = model.probs[scorer.index[s[:k]]] if s[:k] in scorer.index else scorer.spelt(s) if k == 1 else None
            if p is not None:
                out = out + p * total(s[k:])
        return out

    words = sorted(["the", "thing", "über", "語x", "a"])
    assert np.allclose(scorer.score(words), [np.log(total(langid.MARK + w)) for w in words])
    assert np.allclose(scorer.long_word("thing"), scorer.score(["thing"])[0])
    assert np.isfinite(scorer.long_word("ab" * 100_000)).all()


def test_language_id_accuracy_and_cases(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(langid.training_rows(rows))
    held = rows.where(langid.crc_mod("doc_id", 3) == 1).withColumn("p", langid.predict(rows, model)).select("lang", "p.*").toPandas()
    held.columns = ["truth", "lang", "score"]
    assert (held.truth == held.lang).mean() > 0.98 and held.score.between(0, 1).all()
    odd = docs(spark, [*ODD, "123 !!", "½ ² Ⅷ ①", "½cup"]).withColumn("p", langid.predict(rows, model)).select("text", "p").collect()
    for r in odd:
        undetermined = not any(c.isalpha() for c in r.text or "")
        assert (r.p.lang == "und") == undetermined and (r.p.score == 0) == undetermined
    empty = langid.fit(rows.limit(0))
    assert empty.langs == [] and rows.limit(3).select(langid.predict(rows, empty).alias("p")).first().p.lang == "und"


@pytest.mark.parametrize("letters", [1, 10, 14, 39, 40, 200])
def test_unseen_letters_do_not_underflow(letters):
    """Cherokee is spelt with bytes only, so log space has one term a letter; other words of the text still count."""
    own = langid._processor(langid.default_path())
    counts = np.full((own.get_piece_size(), 2), langid.SMOOTHING)
    counts[own.encode("hello")[0], 1] += 1e10
    counts[own.encode("bonjour")[0], 0] += 1e10
    model = langid.Model(["a", "b"], np.zeros(2), counts / counts.sum(axis=0), langid.default_path())
    scorer = langid.Scorer(model)
    word = "\uab70" * letters  # a small letter, three bytes
    assert "\uab70" not in scorer.index and langid.words_of(word) == [word]
    want = np.log(model.probs[scorer.index[langid.MARK]]) + letters * np.log(scorer.bytes[list("\uab70".encode())]).sum(axis=0)
    total, _ = scorer.totals([word])
    assert np.isfinite(total).all() and np.allclose(total[0], want)
    found = scorer.predict([word + " hello hello"])
    assert found.lang[0] == "b" and found.score[0] > 0.5


def test_media_round_trip(spark):
    back = media.read(media.store(docs(spark, ODD).drop("media", "payload"))).collect()
    for r in back:
        raw = (ODD[r.doc_id] or "").encode()
        assert r.n_bytes == len(raw) and r.payload == raw + bytes(-len(raw) % 64 if raw else 64)
        assert media.from_wav(r.media) == r.payload and r.media[:4] == b"RIFF"
        times = [c >> 20 for c in r.landmarks]
        assert times == sorted(times)
    assert media.store(docs(spark, [])).count() == 0
    broken = spark.createDataFrame([(bytearray(b"no wav"),), (None,)], "media binary")
    assert [r.landmarks for r in media.read(broken).collect()] == [None, None]


def test_fingerprints_survive_a_shift():
    """Pairs of a recording are found again, later, when something is put before it."""
    rng = np.random.default_rng(0)
    t = np.arange(40_000)
    x = (128 + 60 * np.sin(t / 9) + 40 * np.sin(t * t / 4e5)).astype(np.uint8)
    a, b = media.fingerprint(x.tobytes()), media.fingerprint(rng.integers(0, 256, 128 * 20).astype(np.uint8).tobytes() + x.tobytes())
    shifted = set((a + (20 << 20)).tolist())
    assert len(shifted & set(b.tolist())) > 0.9 * len(a)


def test_spectrogram_blocks_agree(monkeypatch):
    x = np.random.default_rng(1).integers(0, 256, 30_000).astype(np.uint8).tobytes()
    whole = media.fingerprint(x)
    monkeypatch.setattr(media, "FRAMES_AT_ONCE", 7)
    assert (media.fingerprint(x) == whole).all()


@pytest.mark.parametrize("size", [64, 256, 320, 384, 448, 1344])
def test_the_last_block_reaches_the_spectrogram(size):
    x = np.random.default_rng(2).integers(0, 256, size).astype(np.uint8)
    y = x.copy()
    y[-64:] ^= 0x55
    a, b = (np.concatenate([power for _, power in media.spectrogram(v.tobytes())]) for v in (x, y))
    assert a.shape == b.shape == (1 + -(-max(0, size - 256) // 128), 128) and not np.allclose(a[-1], b[-1])


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, key string, payload string")


@pytest.mark.parametrize("broadcast_rows", [100_000, -1])
def test_archives(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(archives, "BROADCAST_ROWS", broadcast_rows)
    big = "x" * 2000 + "\r\n\r\nWARC/1.1\r\nfiledesc://x\n"
    rows = [(1, "http://a/b c", big), (2, None, big), (7, "http://z", big), (3, "u", None), (4, "u", ""), (5, "v", "short"), (6, "v", "short"), (8, "é://ü", "é" * 600), (9, "k", "é" * 600), (10, "k", "y" * 999), (11, "k", "y" * 999), (12, "k", "z" * 400_000)]
    arc, warc = new_path(spark, "t-arc"), new_path(spark, "t-warc")
    archives.write_arc(pages(spark, rows).repartition(3), arc, target=900)
    assert {r.version for r in archives.read_arc(spark, arc).select("version").distinct().collect()} == {1, 2}
    archives.convert(spark, arc, warc, target=900)
    got = {int(r.key): r for r in archives.read_warc(spark, warc).collect()}
    by_id = {r.record_id: k for k, r in got.items()}
    assert len(got) == len(rows) == len(by_id)
    for k, _, html in rows:
        raw = (html or "").encode()
        same = max(i for i, _, h in rows if (h or "") == (html or ""))
        revisit = len(raw) >= 1000 and same != k
        r = got[k]
        assert (r.record_type, r.refers_to) == (("revisit", str(same)) if revisit else ("response", None))
        assert r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha1(raw).hexdigest() and r.intact
        assert (by_id[r.refers_to_id] if revisit else r.refers_to_id) == (same if revisit else None)


def test_archive_files_end_with_their_last_member(spark):
    rows = [(1, "http://a", "same")] * 5 + [(2, "http://a", "x" * (17 << 20)), (None, "http://a", "y" * 1500), (None, "http://a", "y" * 1500)]
    arc, warc = new_path(spark, "t-arc"), new_path(spark, "t-warc")
    archives.write_arc(pages(spark, rows).repartition(4), arc)
    archives.convert(spark, arc, warc)
    ids = []
    for path in (arc, warc):
        for f in spark.read.format("binaryFile").load(path).collect():
            rest, raw = f.content, b""
            while rest:
                member = zlib.decompressobj(31)
                raw += member.decompress(rest)
                assert member.eof
                rest = member.unused_data
            ids += [line for line in raw.split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(ids) == len(set(ids)) > len(rows)  # the records that open the files have ids as well
    got = archives.read_warc(spark, warc).collect()
    assert len(got) == len(rows) and sorted(r.record_type for r in got) == ["response"] * 7 + ["revisit"] and all(r.intact for r in got)
    (revisit,) = [r for r in got if r.record_type == "revisit"]
    assert revisit.refers_to is None and revisit.refers_to_id in {r.record_id for r in got if r.payload_bytes == 1500} - {revisit.record_id}


def test_archive_parsing_is_strict():
    block = archives.arc_version_block(1, "f.arc")
    good = block + archives.arc_record(1, "f.arc", 0, "http://u", b"body\n\nmore")
    (record,) = archives.parse_arc(good, "f.arc")
    assert record.content == b"body\n\nmore" and record.split() == (b"", b"body\n\nmore")
    for bad in (good[:-6], block + b"http://u 1.1.1.1 20200101 text/html\nbody\n", block.replace(b"1 0", b"2 0") + archives.arc_record(1, "f.arc", 0, "http://u", b"x")):
        with pytest.raises(ValueError):
            list(archives.parse_arc(bad, "f.arc"))
    assert archives.iso_date("2003") == "2003-01-01T00:00:00Z" and archives.iso_date("20030405060708") == "2003-04-05T06:07:08Z"


def test_empty_pages(spark):
    arc, warc = new_path(spark, "t-arc"), new_path(spark, "t-warc")
    archives.write_arc(pages(spark, []), arc)
    archives.convert(spark, arc, warc)
    assert archives.read_warc(spark, warc).count() == 0


def test_crc_rule(spark):
    got = spark.range(50).select("id", langid.crc_mod("id", 3).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 3 for r in got)
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS id").select(langid.crc_mod("id", 3).alias("m")).first().m == -1
