"""SimHash fingerprints and the components of those that differ in few bits, compared bit plane by bit plane."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, id_and_text, map_batches, sized_join
from tidemark.llm.near_dedup import components

_U = np.uint64
ALL = _U(0xFFFFFFFFFFFFFFFF)
#: Members of a cell that are compared with one another; larger cells are split by more bits.
CELL = 1024
#: Cells of at most this many free bits are never split: they cannot hold more than CELL fingerprints.
FREE_BITS = 10


def fingerprint(text: str, n_words: int = 3, seed: int = 42) -> int:
    """Bits that are set in over half of the hashes of all shingles, repeats included; 0 without words."""
    found = text.encode().lower().split()  # of bytes: A-Z alone, and `[\x20\x09-\x0D]` alone
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= n_words:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(found) - n_words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, (ends[n_words - 1 :] - 1).tolist(), strict=True)], _U)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(counts * 2 > len(hashes)))


def fingerprints(documents: DataFrame, n_words: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number, of every row of documents (doc_id, text)."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t, n_words) for t in batch.column(1).to_pylist()], _U)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

        return apply

    return map_batches(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), make, "doc_id bigint, fp bigint", rows=64)


def parts(mask: int, n: int) -> list[int]:
    """The set bits of mask in n masks of consecutive ones, as even as can be."""
    bits = [b for b in range(64) if mask >> b & 1]
    return [sum(1 << b for b in bits[len(bits) * i // n : len(bits) * (i + 1) // n]) for i in range(n)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class PlaneCells:
    """Comparison of all members of cells, 64 at a time: plane b holds bit b of 64 members in one word."""

    def __init__(self, fps: np.ndarray, cells: np.ndarray):
        """cells: the cell of each fingerprint, ascending."""
        self.fps = fps
        new = np.flatnonzero(np.diff(cells, prepend=cells[0] - 1 if len(cells) else 0))
        self.first, self.size = new, np.diff(np.append(new, len(cells)))
        words = -(-self.size // 64)
        self.word_of = np.cumsum(words) - words
        self.words = words
        cell = np.repeat(np.arange(len(new)), self.size)
        place = np.arange(len(fps)) - new[cell]
        self.cell = cell
        word, lane = self.word_of[cell] + (place >> 6), (place & 63).astype(_U)
        edges = np.flatnonzero(np.diff(word, prepend=-1))
        self.planes = [np.bitwise_or.reduceat((fps >> _U(b) & _U(1)) << lane, edges) for b in range(64)]
        self.lanes = np.bitwise_or.reduceat(_U(1) << lane, edges)
        self.word, self.lane = word, lane

    def near(self, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Member, word and the lanes of that word that hold other members within its radius, of all pairs of member and word with any.

        Distances are counted in carry-save form: `counters` are the bits of 64 counters side by side, `over` marks those
        past the radius.  After every eighth plane the pairs of member and word whose lanes are all past it are left out.
        """
        repeat = self.words[self.cell]
        member = np.repeat(np.arange(len(self.fps)), repeat)
        word = np.arange(int(repeat.sum())) - np.repeat(np.cumsum(repeat) - repeat, repeat) + self.word_of[self.cell[member]]
        over = ~self.lanes[word] | (word == self.word[member]).astype(_U) << self.lane[member]
        counters = [np.zeros(len(member), _U) for _ in range(int(radius + 1).bit_length())]
        for b in range(64):
            carry = self.planes[b][word] ^ (_U(0) - (self.fps[member] >> _U(b) & _U(1)))
            for i, c in enumerate(counters):
                counters[i], carry = c ^ carry, c & carry
            over |= carry | self._past(counters, radius)
            if b % 8 == 7:
                alive = np.flatnonzero(over != ALL)
                if len(alive) < len(over):
                    member, word, over, counters = member[alive], word[alive], over[alive], [c[alive] for c in counters]
        return member, word, ~over

    @staticmethod
    def _past(counters: list[np.ndarray], radius: int) -> np.ndarray:
        """Lanes whose counter is above the radius, from the highest bit down."""
        above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
        for i in reversed(range(len(counters))):
            if radius >> i & 1:
                equal &= counters[i]
            else:
                above |= equal & counters[i]
                equal &= ~counters[i]
        return above

    def links(self, radius: int) -> list[tuple[int, int]]:
        """For each component inside a cell its first member with each other one: all components, without all pairs."""
        member, word, lanes = self.near(radius)
        if not len(member):
            return []
        at = np.searchsorted(member, np.arange(len(self.fps) + 1))
        found, seen = [], np.zeros(len(self.lanes), _U)
        for top in np.unique(member).tolist():
            if seen[self.word[top]] >> self.lane[top] & _U(1):
                continue
            seen[self.word[top]] |= _U(1) << self.lane[top]
            stack = [top]
            while stack:
                m = stack.pop()
                span = slice(at[m], at[m + 1])
                fresh = lanes[span] & ~seen[word[span]]
                seen[word[span]] |= fresh
                for w, bits in zip(word[span].tolist(), fresh.tolist(), strict=True):
                    while bits:
                        low = bits & -bits
                        other = int(self.first[self.cell[m]]) + (w - int(self.word_of[self.cell[m]])) * 64 + low.bit_length() - 1
                        found.append((top, other))
                        stack.append(other)
                        bits ^= low
        return found


def _compare(radius: int, most: int = 8192):
    """Whole cells go to the comparison, some thousand members at a time; the last one of a batch waits for the next."""

    def linked(cells: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero(np.diff(cells, prepend=cells[0] - 1))
        sizes = np.diff(np.append(new, len(cells)))
        several = np.repeat(sizes > 1, sizes)
        cells, fps = cells[several], fps[several]
        start = 0
        while start < len(cells):
            stop = min(start + most, len(cells))
            if stop < len(cells):  # back to the edge of a cell, or on to it
                edge = int(np.searchsorted(cells, cells[stop], "left"))
                stop = edge if edge > start else int(np.searchsorted(cells, cells[stop], "right"))
            pairs = np.array(PlaneCells(fps[start:stop], cells[start:stop]).links(radius), np.int64).reshape(-1, 2) + start
            yield pa.RecordBatch.from_arrays([pa.array(fps[pairs[:, i]].view(np.int64)) for i in (0, 1)], ["a", "b"])
            start = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (np.zeros(0, np.int64), np.zeros(0, _U))
        for batch in batches:
            cells = np.concatenate([kept[0], batch.column(0).to_numpy()])
            fps = np.concatenate([kept[1], batch.column(1).to_numpy().view(_U)])
            edge = int(np.searchsorted(cells, cells[-1], "left")) if len(cells) else 0
            if edge:
                yield from linked(cells[:edge], fps[:edge])
            kept = (cells[edge:], fps[edge:])
        if len(kept[0]):
            yield from linked(*kept)

    return run


def _split(cells: DataFrame, masks: list[tuple[int, list[int]]]) -> DataFrame:
    """Each row of cells (cell, free, fp) once for each choice of bits that its free bits offer; masks: free, choices."""
    rows = [(signed(free), signed(choice)) for free, choices in masks for choice in choices]
    table = F.broadcast(cells.sparkSession.createDataFrame(rows, "free bigint, taken bigint"))  # a few thousand rows at most
    taken = cells.join(table, "free")
    return taken.select(F.xxhash64("cell", "taken", F.col("fp").bitwiseAND(F.col("taken"))).alias("cell"), F.col("free").bitwiseAND(F.bitwise_not("taken")).alias("free"), "fp")


def links(distinct: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(a, b): fingerprints that differ in at most `radius` bits, as many as join all components; distinct: fp.

    Two such fingerprints are equal in `blocks - radius` of `blocks` blocks of bits at least, so they meet in a cell of
    every such choice of blocks.  A cell of more than CELL members is split once more: two members that differ in at
    most `radius` of its free bits are equal in one of `radius + 1` parts of them.  That ends, since distinct
    fingerprints that are equal in all but FREE_BITS bits fit in one cell; no cell is capped and no pair is lost.
    """
    whole = (1 << 64) - 1
    starts = [sum(c) for c in combinations(parts(whole, blocks), blocks - radius)]
    cells = distinct.select(F.lit(0).cast("bigint").alias("cell"), F.lit(-1).cast("bigint").alias("free"), "fp")
    cells, frees = _split(cells, [(whole, starts)]), [whole & ~s for s in starts]
    found = []
    while True:
        splittable = sorted({f for f in frees if f.bit_count() > FREE_BITS})
        counts = cells.groupBy("cell").agg(F.count("*").alias("key_rows"))
        crowded = durable(counts.where(F.col("key_rows") > CELL)) if splittable else None
        last = crowded is None or crowded.isEmpty()
        if last:
            calm, dense = cells, None
        else:
            hot = sized_join(cells, crowded, ["cell"], row_bytes=16, counts=crowded)
            can = F.col("key_rows").isNotNull() & F.col("free").isin([signed(f) for f in splittable])
            hot = durable(hot.select("cell", "free", "fp", can.alias("dense")))
            calm, dense = hot.where(~F.col("dense")), hot.where("dense")
        dealt = calm.select("cell", "fp").repartition("cell").sortWithinPartitions("cell", "fp")
        found.append(dealt.mapInArrow(_compare(radius), "a bigint, b bigint"))
        if last:
            break
        choices = [(f, parts(f, radius + 1)) for f in splittable]
        cells, frees = _split(dense.select("cell", "free", "fp"), choices), [f & ~c for f, cs in choices for c in cs]
    return reduce(DataFrame.union, found).distinct()


def simhash_components(documents: DataFrame, radius: int = 3, n_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, class_size (documents of the component).

    A fingerprint bit is set if it is in over half of the XXH64 hashes (seed 42) of all `n_words`-word shingles, repeats
    included; a text of fewer words is one shingle, one without words (null, empty, blank) has fingerprint zero, which
    links like any other.  Fingerprints that differ in at most `radius` bits link; component_id is the smallest doc_id
    that can be reached.  Equal fingerprints are compared once, whatever their number.  Each row is a document; null ids
    are larger than all others, so a component of null ids alone has a null component_id.  An empty table gives an
    empty result.  Other columns are not read.
    """
    docs = durable(fingerprints(id_and_text(documents, id_col, text_col), n_words))
    distinct = durable(docs.groupBy("fp").agg(F.min("doc_id").alias("low_id"), F.count("*").alias("key_rows")))
    joined = durable(links(distinct.select("fp"), radius))
    labels = components(joined).withColumnRenamed("node", "fp")
    # only fingerprints that several rows have or that link need more than their own row
    grouped = distinct.join(labels, "fp", "left").where((F.col("key_rows") > 1) | F.col("label").isNotNull())
    grouped = durable(grouped.withColumn("label", F.coalesce("label", "fp")))
    totals = grouped.groupBy("label").agg(F.min("low_id").alias("component_id"), F.sum("key_rows").alias("class_size"))
    totals = durable(totals.where(F.col("class_size") > 1))
    sizes = grouped.groupBy("label").agg(F.count("*").alias("key_rows"))
    of_fp = sized_join(grouped, totals, ["label"], "inner", row_bytes=32, counts=sizes).select("fp", "component_id", "class_size", "key_rows")
    of_fp = durable(of_fp)
    whole = sized_join(docs, of_fp.drop("key_rows"), ["fp"], row_bytes=32, counts=of_fp.select("fp", "key_rows"))
    return whole.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("class_size", F.lit(1).cast("bigint")).alias("class_size"),
    )
