import random
import zlib
from collections import Counter

import numpy as np
import pytest
from millrace.llm import packing, tokenbin, tokencount
from millrace.llm.tokens import Encoder, Kept, default_path
from tokenizers import Tokenizer

ALPHABET = "ab AB1'sStTdlrevm  \n\t\r\x0b\x0c.,!ééßſ \u0085\x1c　ΣσİǅK日本²½Ⅷ‍😀_-­\x00"


def samples(n: int, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    out = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 16))) for _ in range(n)]
    return out + ["<|endoftext|>", "x<|endoftext|>y <|startoftext|>", "word " * 500, "", "\n\n\nx", "x\n\n", "x\n\ny\nz"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name):
    library, own = Tokenizer.from_file(default_path(name)), Encoder(default_path(name), units=30_000, pretokens=20_000)
    for text in samples(3000):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_transducer_counts_and_chunk_maps_compose():
    library = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    r = random.Random(5)
    # the second one has room for so few states that it forgets all the time
    for bound, n in ((600_000, 3000), (50, 400)):
        machine = tokencount.CountTransducer(default_path("word_bpe_49k.json"), bound=bound)
        for text in samples(n, 2):
            want = len(library.encode(text, add_special_tokens=False).ids)
            assert machine.count(text) == want, repr(text)
            assert machine.count(text, r.randint(1, 6), r.randint(1, 4)) == want, repr(text)


def test_transducer_equals_the_library_on_words_of_few_letters():
    """Long words of few letters have many overlapping merges, and runs of one letter the most."""
    library, machine = Tokenizer.from_file(default_path("word_bpe_49k.json")), tokencount.transducer(default_path("word_bpe_49k.json"))
    r = random.Random(11)
    for letters in ("a", "ab", "the", "inga", "lolo!", "haxe", "=-", "eéè", "日本国", "".join(map(chr, range(97, 123)))):
        for _ in range(250):
            word = "".join(r.choice(letters) for _ in range(r.randint(1, 40)))
            assert machine.count(word) == len(library.encode(word, add_special_tokens=False).ids), word
    for length in (1000, 5000, 20_000):
        word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(length))
        assert machine.count(word) == len(library.encode(word, add_special_tokens=False).ids)
        assert len(machine.moves) + len(machine.pushes) <= machine.bound


def test_caches_are_bounded_by_bytes():
    made = Counter()

    def make(key):
        made[key] += 1
        return bytes(50)

    kept = Kept(make, 20_000, longest=20)
    for k in range(1000):
        assert kept[f"key{k}"] == bytes(50) and kept["often"] == bytes(50) and kept["x" * 21] == bytes(50)
        assert 2 * kept.held <= 20_000 and len(kept) + len(kept.old) <= 20_000 // kept.ENTRY and "x" * 21 not in kept
    assert made["often"] == 1 and made["key5"] == 1 and kept["key5"] and made["key5"] == 2


@pytest.mark.parametrize("chunk", [4096, 50])
def test_count_tokens(docs, rows, no_docs, chunk):
    library = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    got = Counter(map(tuple, tokencount.count_tokens(docs, limit=100, chunk_chars=chunk).collect()))
    want = Counter()
    for doc_id, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want[(doc_id, len((text or "").encode()), n, n > 100)] += 1
    assert got == want
    assert tokencount.count_tokens(no_docs).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 25, 32])
def test_bits_round_trip_and_slices(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1003, dtype=np.uint64)
    payload = tokenbin.pack_bits(ids, bits)
    assert len(payload) == -(-1003 * bits // 8)
    for start, count in ((0, 1003), (5, 17), (1002, 1), (400, 0)):
        assert (tokenbin.unpack_bits(payload, bits, start, count) == ids[start : start + count]).all()


def test_token_archive(spark, docs, rows, no_docs, tmp_path):
    library = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    path = str(tmp_path / "blocks")
    tokenbin.write_token_blocks(docs, path, block_ids=200, shards=3)
    got = sorted(map(tuple, tokenbin.read_token_index(spark, path).collect()), key=lambda r: r[1])
    ids = {}
    for doc_id, text, *_ in rows:
        ids.setdefault(doc_id, []).append(library.encode(text or "", add_special_tokens=False).ids + [0])
    order = sorted((k for k in ids if k is not None)) 
    assert [r[0] for r in got] == [None] + [k for k in order for _ in ids[k]]
    start = 0
    for doc_id, at, n, crc in got:
        assert at == start and n == len(ids[doc_id][0])
        assert crc == zlib.crc32(np.array(ids[doc_id][0], "<u4").tobytes())
        start += n
    assert tokenbin.read_document(spark, path, 1004) == ids[1004][0]
    assert tokenbin.read_document(spark, path, 77777) is None
    assert tokenbin.token_archive(no_docs).count() == 0


def test_lower_bound_is_below_best_fit_and_sound():
    rng = np.random.default_rng(0)
    for k in range(60):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        bins, offsets = packing.best_fit_decreasing(lengths, 100)
        bound = packing.lower_bound(lengths, 100)
        assert -(-int(lengths.sum()) // 100) <= bound <= bins.max() + 1
        for b in range(bins.max() + 1):
            own = sorted(zip(offsets[bins == b], lengths[bins == b]))
            at = 0
            for o, n in own:
                assert o == at
                at += n
            assert at <= 100
    # three items over a half need three bins, whatever their sum
    assert packing.lower_bound(np.array([51, 51, 51]), 100) == 3
    # the sum asks for one bin less than seven items over a third do
    assert packing.lower_bound(np.array([34] * 7), 100) == 4


def test_pack_documents(docs, rows, no_docs):
    library = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    pieces = packing.token_pieces(docs, 256)
    packed = packing.pack_pieces(pieces, 256, items=20, fullness=0.99)
    got = [r.asDict() for r in packed.collect()]
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[(doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in got)
    assert len(places) <= -(-total // 256) + 2
    assert packing.pack_documents(no_docs).count() == 0


def test_equal_rows_are_dealt_apart_and_bounds_steer(spark):
    rows = [(1, 0, 0, 40, 7)] * 3000 + [(k, 0, 0, 1 + k * 37 % 90, k) for k in range(2, 1500)]
    pieces = spark.createDataFrame(rows, packing.PIECE_SCHEMA)
    packed = packing.pack_pieces(pieces, 100, items=400, fullness=0.99)
    got = packed.collect()
    assert Counter((r.doc_id, r.length) for r in got) == Counter((r[0], r[3]) for r in rows)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 100
    least = packing.lower_bound(np.array([r[3] for r in rows]), 100)
    assert least <= len(places) <= least * 1.01 + 1 and all(r.bins >= r.bound for r in got)
    with np.testing.assert_raises(ValueError):
        packing.pack_pieces(pieces, 50)


def test_archive_of_equal_rows_has_them_in_several_shards(spark, tmp_path):
    path = str(tmp_path / "blocks")
    df = spark.createDataFrame([(5, "the same text")] * 4000 + [(4, None), (6, "z")], "doc_id long, text string")
    tokenbin.write_token_blocks(df, path, shards=4)
    assert spark.read.parquet(path).select("shard").distinct().count() > 1
    got = sorted(map(tuple, tokenbin.read_token_index(spark, path).collect()), key=lambda r: r[1])
    n = got[1][2]
    assert [r[1] for r in got] == [0, *range(1, 1 + 4000 * n, n), 1 + 4000 * n] and got[-1][0] == 6


def test_sequences_hold_the_pieces(docs):
    pieces = packing.token_pieces(docs, 256, keep_ids=True)
    packed = packing.pack_pieces(pieces, 256)
    built = {r.sequence_id: list(r.ids) for r in packing.sequences(packed, pieces).collect()}
    for r in packed.collect():
        part = built[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
