import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, tokens, wavelet

TEXTS = [
    None, "", "  ", "don't it's we'll I'M x's.", "naïve café ÉCOLE, Straße! İstanbul. ǅ", "foo<|endoftext|>bar", "a <|startoftext|> b", "<|endoftext|><|endoftext|>x<|ENDOFTEXT|>", "Ünï<|endoftext|>, ß", "a b c\u0085d x\x1cy", "１２３ ½ 99% 3.14", "日本語 テスト。", "ΣΑΣ, ΑΣ.",
    "a" * 3000, "..,, !?x...", "\x00 a\x00b", "it''s '''s", "word'. 'word' rock'n'roll", "plain words " * 900, "é. ́x",
]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(tokens.vocabulary_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_words_in_a_row_are_the_text(reference):
    enc = tokens.WordEncoder(tokens.vocabulary_path(), max_words=20)
    for text, got in zip(TEXTS, enc.encode_all([t and t.encode() for t in TEXTS]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == reference(text), text


def test_a_walk_unpacks_the_pieces_that_it_comes_by(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(wavelet, "PIECE_BYTES", 1024)
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 300, 100_001).astype(np.uint32)
    ids[::3] = 7  # many: planes are searched as a whole
    cut = np.array([100, 0, 40_000, 59_901])
    image = wavelet.encode_shard([1, 2, 3, 4], cut, ids)
    shard = wavelet.WaveletShard(image)
    assert [shard.access(i) for i in (0, 8191, 8192, 77_777, 100_000)] == ids[[0, 8191, 8192, 77_777, 100_000]].tolist()
    assert 0 < shard.unpacked <= 5 * shard.bits < 9 * 13
    fresh = wavelet.WaveletShard(image)
    assert fresh.count(7, 1000, 1010) == (ids[1000:1010] == 7).sum() and fresh.unpacked <= 2 * fresh.bits
    for value in (7, 9, 299, 511, 4000):
        assert shard.occurrences(value) == np.flatnonzero(ids == value).tolist()
    starts = np.array([0, 5, 8192, 100_000, 63_999])
    stops = np.array([100_001, 6, 16_384, 100_001, 64_010])
    value, times = shard.count_first(starts, stops)
    assert value.tolist() == ids[starts].tolist() and times.tolist() == [(ids[a:b] == ids[a]).sum() for a, b in zip(starts, stops, strict=True)]
    assert (shard.decode() == ids).all()


def test_tokens_are_found_in_shards(spark, rows, tmp_path, reference):
    docs = [(i, "alpha beta alpha" if i % 3 else "beta") for i in range(30)] + [(None, "alpha"), (99, None)]
    path = str(tmp_path / "shards")
    wavelet.write_shards(rows(docs, "doc_id long, text string").repartition(3), path, shard_tokens=40)
    shards = wavelet.read_shards(spark, path)
    coded = {i: [*reference(t), wavelet.END_ID] for i, t in docs}
    wanted = [coded[1][0], wavelet.END_ID, 40_000]
    got = sorted((r["token_id"], str(r["doc_id"]), r["place"]) for r in wavelet.find_tokens(shards, wanted).collect())
    assert got == sorted((v, str(i), p) for i, ids in coded.items() for p, v in enumerate(ids) if v in wanted)
    digests = {r["doc_id"]: (r["first_id"], r["first_id_count"]) for r in wavelet.document_digests(shards, ranks=True).collect()}
    assert digests == {i: (ids[0], ids.count(ids[0])) for i, ids in coded.items()}


def test_wavelet_shard_answers_like_a_list():
    rng = random.Random(0)
    for n, high in ((0, 5), (1, 5), (9000, 7), (5000, 49_000), (300, 200_000)):
        ids = [rng.randrange(high) for _ in range(n)]
        counts = [n // 3, n - n // 3]
        shard = wavelet.WaveletShard(wavelet.encode_shard([4, None], np.array(counts), np.array(ids, np.uint32)))
        assert shard.decode().tolist() == ids and shard.doc_ids == [4, None] and shard.counts.tolist() == counts
        for i in rng.sample(range(n), min(n, 40)):
            assert shard.access(i) == ids[i]
            a, b = sorted((rng.randint(0, n), rng.randint(0, n)))
            assert shard.count(ids[i], a, b) == ids[a:b].count(ids[i])
        for v in {*ids[:3], high + 10, 2**21}:
            assert shard.occurrences(v) == [i for i, x in enumerate(ids) if x == v]
    with pytest.raises(IndexError):
        shard.access(300)
    with pytest.raises(ValueError):
        wavelet.WaveletShard(b"nope")


def test_documents_come_back_from_shards(spark, rows, tmp_path, reference):
    docs = [(i * 7 % 17, t) for i, t in enumerate(TEXTS)]
    path = str(tmp_path / "shards")
    wavelet.write_shards(rows(docs, "doc_id long, text string").repartition(5), path, shard_tokens=500)
    shards = wavelet.read_shards(spark, path)
    assert shards.count() >= 2
    start = 0
    for r, (d, t) in zip(wavelet.document_digests(shards).orderBy("doc_id").collect(), sorted(docs, key=lambda x: x[0]), strict=True):
        ids = [*reference(t), 2]
        assert tuple(r) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    empty = str(tmp_path / "none")
    wavelet.write_shards(rows([], "doc_id long, text string"), empty)
    assert wavelet.document_digests(wavelet.read_shards(spark, empty)).count() == 0


def check_packing(docs, out, reference, capacity):
    by_seq, by_doc = {}, {}
    for r in out:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for d, t in docs:
        ids, got = [*reference(t), 0], sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["length"] for r in got] == [len(ids[a : a + capacity]) for a in range(0, len(ids), capacity)]
        for k, r in enumerate(got):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, k * capacity, zlib.crc32(np.array(ids[k * capacity : (k + 1) * capacity], "<u4").tobytes()))
    return len(by_seq)


def test_packing_is_complete_and_tight(rows, reference):
    rng = random.Random(2)
    docs = [(i, " ".join(["alpha"] * rng.randint(0, 90))) for i in range(200)] + [(1000 + i, t) for i, t in enumerate(TEXTS)]
    out = packing.pack(rows(docs, "doc_id long, text string").repartition(6), capacity=64).collect()
    used = check_packing(docs, out, reference, 64)
    assert used <= -(-sum(r["length"] for r in out) // 64) + 2
    assert packing.pack(rows([], "doc_id long, text string")).count() == 0


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    for scale in (1, 30):
        histogram = np.zeros(257, np.int64)
        histogram[1:] = rng.integers(0, 4, 256) * scale
        plan = packing.plan_sequences(histogram, 256)
        used = np.zeros_like(histogram)
        for p, n in plan:
            assert sum(p) <= 256 and n > 0
            np.add.at(used, list(p), n)
        assert (used == histogram).all()
        total = int((np.arange(257) * histogram).sum())
        assert sum(n for _, n in plan) <= 1.02 * total / 256 + 2
    assert any(len(p) == 3 for p in packing.enumerate_patterns(np.arange(1, 65), 64))
