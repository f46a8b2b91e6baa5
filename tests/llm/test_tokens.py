import functools
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm import cases
from tidemark.llm import packing, tokens
from tidemark.llm.queries import BYTE_BPE, WORD_BPE, op4_bpe, op7_best_fit_packing

ODD = [
    None, "", " ", "  two  spaces ", "\n\n\n", "it's I'LL we've 'd", "a\u00a0b\u3000c\u2028d\x85e\x1cf\x1fg\u200bh", "caf\u00e9 cafe\u0301 \u03a3\u0399\u0393\u039c\u0391\u03a3 \u0130stanbul",
    "<|endoftext|>", "x <|endoftext|> y<|startoftext|>", "<|endoftext", "123456789012345678901234567890", "\U0001f600\U0001f468\u200d\U0001f469 \ufffd", "a" * 5000, "!?!?" * 300, "\t\tif x:\r\n\treturn 1", "\x00\x01\x7f", "\u1e9e\u00df\ufb01 \u01c5 \u0345",
]


def native(path):
    t = Tokenizer.from_file(path)
    t.no_padding(), t.no_truncation()
    return t


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_odd_texts_as_the_library_has_them(path):
    t, mine = native(path), tokens.Chunks(path)
    for text in ODD:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(mine.encode([text or ""])[0], "<u4").tolist() == ids, text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library_has_it(text):
    for path in (BYTE_BPE, WORD_BPE):
        ids = native_cached(path).encode(text, add_special_tokens=False).ids
        codec = tokens.chunks(path)
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == ids
        if path == BYTE_BPE:
            assert codec.decode(codec.encode([text])[0]) == native_cached(path).decode(ids, skip_special_tokens=False)


def test_every_code_point_as_the_library_has_it():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"{c}a:{c}1 {c}" for c in points[:0x500] + points[0x500:0x20000:37] + points[0x20000::2111]]
    for path in (BYTE_BPE, WORD_BPE):
        found = tokens.Chunks(path).encode(texts)
        for text, mine, e in zip(texts, found, native_cached(path).encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(mine, "<u4").tolist() == e.ids, ascii(text)


def test_latin_texts_go_word_by_word_as_the_library_has_them():
    t, mine = native_cached(WORD_BPE), tokens.Chunks(WORD_BPE)
    latin = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC]]
    texts = [f"a{x}b {x} {y}{x}s 1{x}{y}2 '{x} {x}'s" for x, y in zip(latin, latin[7:] + latin[:7], strict=True)]
    assert sum(mine.direct(text) is not None for text in texts) > 500 and not mine.known.ids
    assert all(mine.direct(text) is None for text in ("\u0130", "a \u03b1", "x<|endoftext|>"))
    for text in texts:
        assert np.frombuffer(mine.encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_a_small_cache_kept_from_task_to_task_changes_nothing(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet").repartition(7)
    whole, small = (packing.pieces(table, WORD_BPE, cached=size, together=chars).collect() for size, chars in ((128 << 20, 4 << 20), (1 << 12, 1)))
    assert sorted(whole) == sorted(small)



@functools.cache
def native_cached(path):
    return native(path)


def test_query_against_the_library(spark, data):
    t = native(BYTE_BPE)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = op4_bpe(spark, data).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded.encode()))


def check_packing(found, ids_of, capacity):
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert pieces.keys() == ids_of.keys()
    for doc_id, parts in pieces.items():
        ids, parts = ids_of[doc_id], sorted(parts, key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in parts] == [(k, a, min(capacity, len(ids) - a)) for k, a in enumerate(range(0, len(ids), capacity))]
        assert all(zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for r in parts)
    return len(bins)


def decreasing_best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms[rooms.index(min(fits))] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


def test_packing_query(spark, data):
    t = native(WORD_BPE)
    ids_of = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 0] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = op7_best_fit_packing(spark, data).collect()
    n = check_packing(found, ids_of, 2048)
    assert n <= decreasing_best_fit([r.length for r in found], 2048)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=12), st.integers(40, 64))
def test_plan_places_every_piece_once_and_packs_like_best_fit(histogram, capacity):
    runs = packing.plan(histogram, capacity)
    ranks, bins = defaultdict(list), defaultdict(list)
    for length, low, high, each, first, base in runs:
        for k in range(high - low):
            ranks[length].append(low + k)
            bins[first + k // each].append((base + k % each * length, length))
    assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in histogram.items()}
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == decreasing_best_fit([x for x, n in histogram.items() for _ in range(n)], capacity)


def test_repeated_rows_take_places_of_their_own(spark):
    table = cases.documents(spark, ["word " * 10] * 3).unionByName(cases.documents(spark, ["word " * 10] * 3))
    found = packing.best_fit_pack(table, WORD_BPE, capacity=16).collect()
    assert len(found) == 6 and len({(r.sequence_id, r.offset) for r in found}) == 6


def test_one_long_word_takes_linear_time():
    word = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(300_000))
    for path in (BYTE_BPE, WORD_BPE):
        codec = tokens.Chunks(path)
        codec.encode([word, word[:-1] + "A"])
        codec.forget()
        assert not codec.known.ids and not codec.packed.ids
