import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import ROWS, vocabulary

from tidelog.llm import bpe, packing, token_files
from tidelog.llm.common import word_cache
from tidelog.llm.library_ids import library_ids
from tidelog.llm.range_coder import decode_segment, encode_segment

TRICKY = ["", " ", "  ", "a", "a  b", " lead", "trail ", "a   b \n c", "x<|endoftext|>y", "foo  <|endoftext|>  bar\t\tq", "a.\nb,\nc ,d . e", "×, ÷. a", "a!. b", "\n\na",
          "3, 4. 5.6 .7", "'s, don', x", "\x01, a. b", "İx, y", "x́, y", "日本語 テスト 🙂🙂", "\x1c a\x85b", "ΑΣ ΣΑΣ. ½"]


def _library(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return t, [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_put_together_are_the_library_s_ids(name, spaces):
    texts = TRICKY + [t or "" for _, t in ROWS]
    got = library_ids(vocabulary(name), spaces).bytes_of(pa.array(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == _library(name, texts)[1]


@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_every_character_before_a_stop(name, spaces):
    """All characters of the basic plane (but surrogates) with a comma or stop behind them, inside and at the end."""
    chars = [chr(k) for k in range(1, 0x10000) if not 0xD800 <= k < 0xE000]
    texts = [f"a{c}{'.,'[k % 2]} x{c}{'.,'[k // 2 % 2]}" for k, c in enumerate(chars)] + ["İ.", "KADIKÖYİ, x", "İ. x"]
    got = library_ids(vocabulary(name), spaces).bytes_of(pa.array(texts))
    assert [t for t, x, want in zip(texts, got, _library(name, texts)[1]) if np.frombuffer(x, "<u4").tolist() != want] == []


def test_word_caches_of_operators_do_not_add_up():
    a = word_cache("a")
    a["x"] = 1
    assert word_cache("a") is a and word_cache("b") == {} and word_cache("a") == {}


def test_prefix_dynamic_programming_is_exact_and_decodes():
    texts = TRICKY + [t or "" for _, t in ROWS] + ["aaaaaaaaaaaaab" * 9, "unbelievablyinternationalisation", "ABABABAB", "=========", "hello" * 40]
    own = bpe.prefix_bpe(vocabulary("byte_bpe_50k.json"))
    library, want = _library("byte_bpe_50k.json", texts)
    got = own.encode(pa.array(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert [own.decode(x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_encode_decode_rows(docs, empty):
    rows = bpe.encode_decode(docs, vocabulary("byte_bpe_50k.json")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["decoded"]) for r in rows) == sorted((i is None, i or 0, t or "") for i, t in ROWS)
    assert bpe.encode_decode(empty, vocabulary("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 64, 65, 1000, 5000])
def test_range_coder_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 50000
    assert decode_segment(encode_segment(ids, block=64)).tolist() == ids.tolist()


def test_range_coder_extremes_and_damage():
    for ids in (np.zeros(3000, int), np.full(3000, (1 << 18) - 1), np.arange(3000) % 2 * 262143):
        assert decode_segment(encode_segment(ids, block=512)).tolist() == ids.tolist()
    data = bytearray(encode_segment(np.arange(4000) % 977))
    data[-40] ^= 4
    with pytest.raises(ValueError):
        decode_segment(bytes(data))
    with pytest.raises(ValueError):
        encode_segment(np.array([1 << 18]))


def test_damage_anywhere_is_found_or_harmless():
    """Wherever a byte behind the header is damaged, also in the bits that aren't coded: never other ids, no other error."""
    ids = np.random.default_rng(5).zipf(1.2, 3000) % 50000
    data = encode_segment(ids, block=128)
    for at in [*range(30, len(data), 41), *range(len(data) - 12, len(data))]:
        changed = bytearray(data)
        changed[at] ^= 0x91
        try:
            got = decode_segment(bytes(changed))
        except ValueError:
            continue
        assert got.tolist() == ids.tolist()


def test_ids_not_named_cost_their_plain_bits():
    """Ids without any repetition: the bits below the highest are kept as they are, so a segment has the room of these and a little more."""
    ids = np.random.default_rng(6).permutation(1 << 18)[:100_000] | 1 << 17
    data = encode_segment(ids)
    assert decode_segment(data).tolist() == ids.tolist() and 17 * len(ids) / 8 < len(data) < 18 * len(ids) / 8


def test_token_files_are_in_order(docs, empty):
    lib = library_ids(vocabulary("byte_bpe_50k.json"), True)
    rows = sorted(token_files.round_trip(docs, vocabulary("byte_bpe_50k.json")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    want = sorted(zlib.crc32(x + b"\x02\0\0\0") for x in lib.bytes_of(pa.array([t or "" for _, t in ROWS])))
    assert sorted(r["ids_crc32"] for r in rows) == want
    assert token_files.round_trip(empty, vocabulary("byte_bpe_50k.json")).count() == 0


def test_packing_covers_every_id_once(docs, empty):
    lib = library_ids(vocabulary("word_bpe_49k.json"), False)
    rows = packing.pack(docs, vocabulary("word_bpe_49k.json"), capacity=256).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert r["length"] == len(r["ids"]) // 4
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    for (i, t), ids in zip(ROWS, lib.bytes_of(pa.array([t or "" for _, t in ROWS])), strict=True):
        if i not in (14, None):
            own = sorted(by_doc[i], key=lambda r: r["start"])
            assert b"".join(r["ids"] for r in own) == ids + b"\x01\0\0\0" and {r["doc_tokens"] for r in own} == {len(ids) // 4 + 1}
    assert packing.pack(empty, vocabulary("word_bpe_49k.json")).count() == 0


def test_balance_fills_the_least_number_of_sequences():
    lengths = [int(x) for x in np.random.default_rng(3).integers(1, 100, 500)]
    out = packing.balance(lengths, 100)
    assert len({k for _, _, _, k, _ in out}) == -(-sum(lengths) // 100)
    assert sum(take for _, _, take, _, _ in out) == sum(lengths)
    costs = {}
    for _, _, take, k, _ in out:
        costs[k] = costs.get(k, 0) + packing.piece_cost(take)
    assert max(costs.values()) < 1.2 * min(v for k, v in costs.items() if k != max(costs))
