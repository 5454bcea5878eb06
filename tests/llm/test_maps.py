"""Token counts, packing and audio columns against their libraries and by exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from vertexloom.llm import mpeg, packing, token_counts
from vertexloom.llm.queries import QUERIES

D = "/root/testdata/sf0.001"
CASES = [None, "", " ", "it's  TWO   spaces\n\n x", "É" * 300, "a" * 3000, "日本語 text 😀", "İ x\x1cy", "12345 6.7", "word " * 5000, "a <|endoftext|> b", "É", "Привет, ΟΔΟΣ Σ ΣΑΣ! ǅ ﬁ", "漢字かな交じり文 12３ हिन्दी ١٢٣ ½", "😀👩\u200d👩 don't", "<|endoftext|>a<|startoftext|> b<|endoftext|", "e\u0301 x\u2028y\u200bz"]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([(i, x, "t", 1) for i, x in enumerate(CASES)] + [(1, "", "t", 1), (None, "x", "t", 1)], "doc_id long, text string, piece string, n_tokens int")


def test_token_counts(spark, cases):
    own = Tokenizer.from_file(path := P.path("word_bpe_49k.json"))
    want = lambda x: len(own.encode(x or "", add_special_tokens=False).ids)
    rows = token_counts.count_tokens(cases, path).collect()
    assert len(rows) == len(CASES) + 2
    for r in rows:
        if r.doc_id is not None:
            x = CASES[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(x.encode()), want(x), want(x) > 2048)
    assert token_counts.count_tokens(cases.limit(0), path).collect() == []
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in QUERIES["op5_token_counts"](spark, D).collect()}
    assert got == {k: want(x) for k, x in text.items()}


def check_packed(rows, text, own):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for x in by_seq.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 2048
    assert by_doc.keys() == text.keys()
    for k, x in by_doc.items():
        ids = np.array([*own.encode(text[k] or "", add_special_tokens=False).ids, 0], "<u4")
        x.sort(key=lambda r: r.piece)
        assert [r.piece for r in x] == list(range(len(x))) and sum(r.length for r in x) == len(ids) and all(r.length == 2048 for r in x[1:])
        for r in x:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    return len(by_seq)


def test_packing_in_many_groups(spark):
    """Groups have sequences of their own, of which each leaves at most its last ones open."""
    path, rnd = P.path("byte_bpe_50k.json"), random.Random(2)
    own, text = Tokenizer.from_file(path), {i: " the" * rnd.choice([0, 3, 40, 500, 900, 1500, 2047, 2048, 5000]) for i in range(400)}
    df = spark.createDataFrame(list(text.items()), "doc_id long, text string").repartition(5)
    for group in (400, 50, 7):
        rows = packing.pack(df, path, group=group).collect()
        used, groups = check_packed(rows, text, own), -(-sum(r.length < 2048 for r in rows) // group)
        assert used <= -(-sum(r.length for r in rows) // 2048) + 2 * groups + 40
    again = {(r.doc_id, r.piece): (r.sequence_id, r.offset) for r in packing.pack(df, path, group=50).collect()}
    assert len(again) == len(rows)


def test_packing(spark, cases):
    own = Tokenizer.from_file(path := P.path("byte_bpe_50k.json"))
    check_packed(packing.pack(cases.where("doc_id <> 1"), path).collect(), {i: x for i, x in enumerate(CASES) if i != 1}, own)
    assert packing.pack(cases.where("doc_id = 1 or doc_id is null"), path).count() == 3
    assert packing.pack(cases.limit(0), path).collect() == []
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    rows = QUERIES["op8_best_fit_packing"](spark, D).collect()
    used = check_packed(rows, text, own)
    assert used <= -(-sum(r.length for r in rows) // 2048) * 1.03 + 1


def test_sum_of_squares_by_brute_force():
    rnd = np.random.default_rng(5)
    lengths = rnd.integers(1, 20, 60)
    seq, offset = packing.sum_of_squares(lengths, 20)
    open_bins, where = [], []  # gaps
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])

        def total(g, n=n):
            gaps = sorted(open_bins)
            gaps.remove(g)
            gaps += [g - n] * (g > n)
            return sum(gaps.count(x) ** 2 for x in set(gaps))

        fits = sorted({g for g in open_bins if g >= n}, key=lambda g: (total(g), g))
        g = fits[0] if fits else 20
        if fits:
            open_bins.remove(g)
        open_bins += [g - n] * (g > n)
        where.append(20 - g)
    assert [int(offset[i]) for i in np.argsort(-lengths, kind="stable")] == where


def test_audio_columns(spark, cases):
    rows = mpeg.audio_columns(cases).collect()
    assert len(rows) == len(CASES) + 2
    for r in rows:
        if r.doc_id is not None:
            raw = (CASES[r.doc_id] or "").encode()
            assert bytes(r.payload) == raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
            assert r.duration_samples == 1152 * len(r.frame_offsets) == 1152 * r.declared_frames and r.damaged == r.skipped == 0
            assert all(r.media[o] == 255 for o in r.frame_offsets)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    for r in QUERIES["op7_mpeg_audio"](spark, D).collect():
        p = mpeg.payload_of(text[r.doc_id])
        assert (r.payload_sha256, r.tail_crc32, r.payload_bytes) == (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p))


def test_reader_resynchronises_and_finds_damage():
    rnd = random.Random(2)
    payload = rnd.randbytes(64 * 100)
    data = mpeg.write(payload)
    assert mpeg.read(data)[0] == payload
    s = mpeg.parse(data)
    cut = s.offsets[3]
    junk = mpeg.parse(data[:cut] + b"\xff\xfa\xe4\xc0 junk \xff" + data[cut:] + b"TAG" + bytes(125))
    assert junk.samples == s.samples and junk.skipped == 11 and b"".join(junk.bodies) == b"".join(s.bodies) and "TAG" in junk.tags
    hurt = bytearray(data)
    hurt[s.offsets[2] + 8] ^= 1
    assert mpeg.parse(bytes(hurt)).damaged == 1
    assert mpeg.parse(data[: s.offsets[-1] + 5]).skipped == 5
    assert mpeg.parse(b"").samples == mpeg.parse(b"\xff\xfa").samples == 0


def test_vbri_table():
    h = bytes([0xFF, 0xFA, 5 << 4 | 4, 0xC0])
    size = mpeg.header(h).size
    table = b"VBRI" + bytes(6) + (size * 3).to_bytes(4) + (2).to_bytes(4) + (2).to_bytes(2) + (1).to_bytes(2) + (2).to_bytes(2) + (1).to_bytes(2) + size.to_bytes(2) * 2
    first = (h + bytes(32) + table).ljust(size, b"\0")
    s = mpeg.parse(first + (h + mpeg.crc16(h[2:] + mpeg.SIDE).to_bytes(2)).ljust(size, b"\0") * 2)
    assert (s.declared_frames, s.declared_bytes, s.toc, len(s.offsets), s.damaged) == (2, size * 3, (size, size), 2, 0)


def test_no_bitrate_is_missing_room():
    assert all(mpeg.read(mpeg.write(p))[0] == p for n in range(64, 64 * 40, 64) for p in [bytes(range(1, 65)) * (n // 64)])


def test_payload_that_looks_like_a_closing_tag():
    """'TAG' at each offset of the last 256 bytes of payloads that end in frames of different sizes."""
    for n in (64, 128, 192, 960, 1024, 64 * 33):
        for at in range(max(0, n - 256), n - 2):
            payload = bytes(b"x" * at + b"TAG").ljust(n, b"x")
            got, s = mpeg.read(mpeg.write(payload))
            assert got == payload and s.skipped == 0 and "TAG" not in s.tags and len(s.offsets) == s.declared_frames
    data = mpeg.write(payload)
    with pytest.raises(ValueError, match="declared"):
        mpeg.read(data[:-1])
