"""BPE encoding and decoding of whole texts with a public byte-level vocabulary."""

from __future__ import annotations

import gc
import hashlib
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm import bpe
from tidemark.llm.common import give_back, id_and_text, small_batches

#: Unicode white space, as the tokenizers' patterns take it (Python's own class has four control characters more).
SPACE = " \t-\r\x85\xa0  -     　"
#: Bytes that a worker's caches of chunks and of words hold each before they start anew, counting ENTRY for an entry besides its text and ids.
CACHED, ENTRY = 64 << 20, 180
#: Characters of the texts that are encoded together, one text at least; and rows whose texts are held at a time.
TOGETHER, ROWS = 1 << 20, 4096
#: Letters and numbers up to U+024F, and the characters of texts that are split by these alone (the others need Unicode's tables).
LATIN_LETTERS, LATIN_NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼½¾"
LATIN_TEXT = "\\x00-\u024f\u2010-\u2027€"


#: Letters and numbers that the regex module knows and the vocabularies' own patterns, of Unicode 16, do not (fixed values).
LATER_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 "
    "18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 "
    "1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
#: Lower case of letters that Python's tables do not have yet (fixed values).
LATER_LOWER = {c: c + 1 for c in (0x1C89, 0xA7CC, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA)} | {0xA7CB: 0x264, 0xA7DC: 0x19B}
LATER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def _set(ranges: str) -> str:
    return "".join("-".join(chr(int(c, 16)) for c in r.split("-")) for r in ranges.split())


_LATER = regex.compile(f"[{_set(LATER_LETTERS + ' ' + LATER_NUMBERS)}]")
_LATER_CAPITAL = regex.compile(f"[{''.join(map(chr, LATER_LOWER))}]")


def _without_later(pattern: str) -> str:
    """The pattern with the letters and numbers of Unicode 16 only."""
    return "(?V1)" + pattern.replace(r"\p{L}", rf"[\p{{L}}--[{_set(LATER_LETTERS)}]]").replace(r"\p{N}", rf"[\p{{N}}--[{_set(LATER_NUMBERS)}]]")


def _explicit(pattern: str) -> str:
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")


def lowered(text: str) -> str:
    """NFC and lower case, character by character: no context rule for a final sigma."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    if _LATER_CAPITAL.search(text):
        text = text.translate(LATER_LOWER)
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


class Cache:
    """Ids by text, with the bytes that they take."""

    def __init__(self, most: int = CACHED):
        self.ids: dict[str, bytes] = {}
        self.held, self.most = 0, most

    def room(self) -> dict[str, bytes]:
        """What is cached; nothing if the cache was full."""
        if self.held > self.most:
            self.ids.clear()
            self.held = 0
        return self.ids

    def add(self, items: dict[str, bytes]) -> None:
        self.ids.update(items)
        self.held += ENTRY * len(items) + sum(map(len, items)) + sum(map(len, items.values()))


class Chunks:
    """Ids of the parts of a text between white spaces, as bytes of little-endian unsigned 32-bit integers.

    No token reaches from a chunk into the white space after it, so a text's ids are its chunks' ids in a row.
    Distinct new chunks of a batch are encoded together, by one walk over the trie of their words.
    """

    def __init__(self, path: str):
        self.encoder, spec = bpe.load(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.normalize = lowered if spec.get("normalizer") else lambda t: t
        if spec.get("normalizer"):  # white space is dropped
            words = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
            self.chunk = re.compile(f"[^{SPACE}]+")
            self.beyond_latin = re.compile(f"[^{LATIN_TEXT}]")
            latin = words.replace(r"[\p{L}]", f"[{LATIN_LETTERS}]").replace(r"[\p{N}]", f"[{LATIN_NUMBERS}]").replace(r"\p{L}\p{N}", LATIN_LETTERS + LATIN_NUMBERS)
            self.latin_words = re.compile(_explicit(latin))
        else:
            words = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            self.chunk = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
            self.latin_words = None
        self.words = regex.compile(_explicit(words))
        self.later_words = regex.compile(_without_later(_explicit(words)))
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.alphabet = dict(enumerate(bpe.byte_alphabet()))
        back = {c: b for b, c in self.alphabet.items()}
        self.token_bytes = {}
        for token, i in self.encoder.ids.items():
            self.token_bytes[i] = bytes(back[c if ord(c) < bpe.TrieEncoder.SHIFT else chr(ord(c) - bpe.TrieEncoder.SHIFT)] for c in token)
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.known, self.packed = Cache(), Cache()
        gc.freeze()  # the tables stay as long as the worker: later collections pass them over

    def split(self, text: str) -> list[str]:
        """Normalised chunks; a special token's text is a chunk of its own, and ends the white space before it."""
        if self.specials and "<|" in text and self.specials.search(text):
            return [c for part in self.specials.split(text) for c in ([part] if part in self.special else self.chunk.findall(self.normalize(part)))]
        return self.chunk.findall(self.normalize(text))

    def direct(self, text: str) -> list[str] | None:
        """The words of a Latin text by one pattern of `re`, with no chunks between; None for other texts, which `split` takes."""
        if self.latin_words is None or ("<|" in text and self.specials and self.specials.search(text)):
            return None
        text = self.normalize(text)
        return None if self.beyond_latin.search(text) else self.latin_words.findall(text)

    def pieces(self, chunk: str) -> list[str]:
        """A chunk's words, as the vocabulary's pattern parts them; letters alone are one word."""
        letters = chunk[1:] if chunk[0] == " " else chunk
        if letters.isalpha():
            return [chunk]
        if letters[-1:] in (".", ",", ";", ":") and letters[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return (self.later_words if not chunk.isascii() and _LATER.search(chunk) else self.words).findall(chunk)

    def learn(self, chunks: set[str], words: set[str]) -> None:
        """Encode the chunks and words that are not cached.  A full cache starts anew."""
        known, packed, special = self.known.room(), self.packed.room(), self.special
        chunks = chunks.difference(known)
        self.known.add({c: array("I", [special[c]]).tobytes() for c in chunks.intersection(special)})
        pieces = {c: self.pieces(c) for c in chunks.difference(special)}
        new = words.union(chain.from_iterable(pieces.values())).difference(packed)
        # ASCII letters and digits stand for themselves in the byte alphabet
        symbols = {w: self.encoder.word(w if w.isascii() and w.isalnum() else w.encode().decode("latin-1").translate(self.alphabet)) for w in new}
        ids = self.encoder.encode(symbols.values())
        self.packed.add({w: array("I", ids[s]).tobytes() for w, s in symbols.items()})
        self.known.add({c: packed[ws[0]] if len(ws) == 1 else b"".join([packed[w] for w in ws]) for c, ws in pieces.items()})

    def forget(self, most: int = CACHED) -> None:
        """Drop what is cached, and bound what comes next; the vocabulary's tables stay with the worker."""
        self.known, self.packed = Cache(most), Cache(most)
        self.encoder.fits.clear()
        self.encoder.edges.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        collects = gc.isenabled()
        gc.disable()  # lists and dictionaries of strings by the hundred thousand, and no cycle among them
        try:
            words = [self.direct(t) for t in texts]
            split = [self.split(t) if ws is None else [] for t, ws in zip(texts, words, strict=True)]
            self.learn(set(chain.from_iterable(split)), set(chain.from_iterable(ws for ws in words if ws)))
            chunk, word = self.known.ids.__getitem__, self.packed.ids.__getitem__
            return [b"".join(map(chunk, cs) if ws is None else map(word, ws)) for cs, ws in zip(split, words, strict=True)]
        finally:
            if collects:
                gc.enable()

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, array("I", ids))).decode("utf-8", "replace")


_CHUNKS: dict[str, Chunks] = {}


def chunks(path: str) -> Chunks:
    """The vocabulary's tables are kept from task to task."""
    if path not in _CHUNKS:
        _CHUNKS[path] = Chunks(path)
    return _CHUNKS[path]


def map_encoded(
    rows: DataFrame,
    path: str,
    make: Callable[[Chunks, pa.RecordBatch, list[bytes]], pa.RecordBatch],
    schema: str,
    cached: int = CACHED,
    keep: bool = True,
    together: int = TOGETHER,
) -> DataFrame:
    """make(encoder, batch, the batch's encoded texts) on parts of the rows (doc_id, text) of about `together` characters.

    The more words are walked together, the more prefixes they share.  If the worker is to `keep` them for its next task,
    its caches, of `cached` bytes each, and the vocabulary's tables stay when a task ends; else they go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = chunks(path)
        if codec.packed.most != cached:
            codec.forget(cached)
        try:
            for whole in batches:
                for first in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(first, ROWS)
                    texts, start, size = batch.column(1).to_pylist(), 0, 0
                    for at, text in enumerate(texts):
                        if size and size + len(text) > together:
                            yield make(codec, batch.slice(start, at - start), codec.encode(texts[start:at]))
                            start, size = at, 0
                        size += len(text)
                    yield make(codec, batch.slice(start), codec.encode(texts[start:]))
        finally:
            if not keep:
                codec.forget()
                _CHUNKS.pop(path, None)
                codec = None
            give_back()

    return small_batches(rows).mapInArrow(run, schema)


def encode_decode(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: bool = True) -> DataFrame:
    """Encode every whole text, then decode its ids.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with outputs, ids (array<bigint>) and decoded.
    A null or empty text has no tokens and decodes to an empty text.  Rows are independent: repeated rows give repeated
    results, an empty table an empty result; other columns are not read.  A very long text or word is encoded whole, in
    time linear in its length.  Narrow: no shuffle, and a task holds one Arrow batch and its bounded word cache.
    """
    extra = ", ids array<bigint>, decoded string" if outputs else ""

    def made(codec: Chunks, batch: pa.RecordBatch, encoded: list[bytes]) -> pa.RecordBatch:
        decoded = [codec.decode(e) for e in encoded]
        columns = [
            batch.column(0),
            pa.array([len(e) // 4 for e in encoded], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in encoded]),
            pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
        ]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if outputs:
            columns += [pa.array([array("I", e).tolist() for e in encoded], pa.list_(pa.int64())), pa.array(decoded)]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(columns, names)

    rows = id_and_text(documents, id_col, text_col)
    return map_encoded(rows, path, made, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{extra}")
