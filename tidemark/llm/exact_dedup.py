"""Exact deduplication: partitions by length and content hash, compressed radix tries, owners at their terminals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, numbered, sized_join, small_batches


class _Node:
    __slots__ = ("edge", "children", "owner")

    def __init__(self, edge: bytes, owner: list | None = None):
        self.edge = edge
        self.children: dict[int, _Node] = {}
        self.owner = owner


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Patricia:
    """A compressed radix trie of whole byte strings.  A terminal's owner is [key, rows, payload, rows of that key], the key the best so far."""

    def __init__(self):
        self.root = _Node(b"")
        self.held = 0

    def insert(self, text: bytes, key: tuple, rows: int, payload=None, of_key: int = 1) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = _Node(text[at:], [key, rows, payload, of_key])
                self.held += len(text) - at
                return
            edge = child.edge
            n = len(edge) if text.startswith(edge, at) else _shared(edge, text[at : at + len(edge)])
            if n < len(edge):
                upper = _Node(edge[:n])
                child.edge = edge[n:]
                upper.children[child.edge[0]] = child
                node.children[text[at]] = child = upper
            node, at = child, at + n
        owner = node.owner
        if owner is None:
            node.owner = [key, rows, payload, of_key]
        else:
            owner[1] += rows
            if key > owner[0]:
                owner[0], owner[3] = key, of_key
            elif key == owner[0]:
                owner[3] += of_key

    @staticmethod
    def walk(top: _Node, above: bytes = b"") -> Iterator[tuple[bytes, list]]:
        stack = [(top, above)]
        while stack:
            node, path = stack.pop()
            path += node.edge
            if node.owner is not None:
                yield path, node.owner
            stack.extend((c, path) for c in node.children.values())

    def drain(self, to: int = 0) -> Iterator[tuple[bytes, list]]:
        """Spill subtree by subtree, the largest first, until at most `to` bytes are held."""
        if not to:
            yield from self.walk(self.root)
            self.root, self.held = _Node(b""), 0
            return
        sizes = {first: sum(len(p) for p, _ in self.walk(child)) for first, child in self.root.children.items()}
        for first in sorted(sizes, key=sizes.get, reverse=True):
            if self.held <= to:
                return
            yield from self.walk(self.root.children.pop(first))
            self.held = max(0, self.held - sizes[first])


#: Rows of a trie's terminals on their way to the partition of their length and hash.
PARTIAL = "n_bytes int, content_hash bigint, body binary, owner bigint, n_owners bigint, n_rows bigint"
CLASSES = "text_sha256 string, owner bigint, n_owners bigint, group_size bigint"


def _key(doc_id: int | None, sign: int) -> tuple:
    """Owners compare by id, a null id after all others."""
    return (False, 0) if doc_id is None else (True, sign * doc_id)


def _id(key: tuple, sign: int) -> int | None:
    return sign * key[1] if key[0] else None


def _partial(held_bytes: int, sign: int):
    """Insert a partition's texts; equal ones leave as one row.  Past held_bytes the largest subtrees spill to the shuffle."""

    def rows(terminals) -> pa.RecordBatch:
        t = [(body, *o) for body, o in terminals]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([len(x[0]) for x in t], pa.int32()),
                pa.array([x[3] for x in t], pa.int64()),
                pa.array([x[0] for x in t], pa.binary()),
                pa.array([_id(x[1], sign) for x in t], pa.int64()),
                pa.array([x[4] for x in t], pa.int64()),
                pa.array([x[2] for x in t], pa.int64()),
            ],
            ["n_bytes", "content_hash", "body", "owner", "n_owners", "n_rows"],
        )

    def run(batches):
        trie = Patricia()
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            for body, h, i in zip(bodies, batch.column("content_hash").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                trie.insert(body, _key(i, sign), 1, h)
            if trie.held > held_bytes:
                yield rows(trie.drain(held_bytes // 2))
        yield rows(trie.drain())

    return run


def _owners(sign: int):
    """A partition arrives sorted by length and hash, one subtree of the whole trie after another; each leaves when it is complete.

    So this trie holds the texts of one length and hash, mostly one; the tries that hold many are those before the shuffle.
    """

    def rows(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in found], pa.string()),
                pa.array([_id(x[1][0], sign) for x in found], pa.int64()),
                pa.array([x[1][3] for x in found], pa.int64()),
                pa.array([x[1][1] for x in found], pa.int64()),
            ],
            ["text_sha256", "owner", "n_owners", "group_size"],
        )

    def run(batches):
        trie, at = Patricia(), None
        done = lambda: [(hashlib.sha256(b).hexdigest(), o) for b, o in trie.drain() if o[1] > 1]
        for batch in batches:
            found = []
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for n_bytes, h, body, owner, n_owners, n in zip(*columns, strict=True):
                if at != (n_bytes, h):
                    found += done()
                    at = (n_bytes, h)
                trie.insert(body, _key(owner, sign), n, None, n_owners)
            yield rows(found)
        yield rows(done())

    return run


def owners(documents: DataFrame, keep: str = "max", held_bytes: int = 48 << 20) -> DataFrame:
    """Texts that several rows have: text_sha256, owner (the id of the row that stays), n_owners (rows of that id), group_size.

    documents: doc_id, text.  A task's trie collapses copies before the shuffle, so that a text which a third of all rows
    have reaches its partition as one row a task.
    """
    sign = {"max": 1, "min": -1}[keep]
    bodies = documents.select(F.col("text").cast("binary").alias("body"), F.xxhash64("text").alias("content_hash"), F.col("doc_id").cast("bigint").alias("doc_id"))
    partial = small_batches(bodies).mapInArrow(_partial(held_bytes, sign), PARTIAL)
    dealt = partial.repartition("n_bytes", "content_hash").sortWithinPartitions("n_bytes", "content_hash")
    return dealt.mapInArrow(_owners(sign), CLASSES)


def marked(documents: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row and column of documents with keep_id, group_size, kept and text_sha256 in one struct column, `dedup`.

    A row stays if it has its text's owner id.  Where several rows have it they are numbered, and the first stays.
    """
    rows = documents.select(F.struct("*").alias("doc"), F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    classes = durable(owners(rows.select("doc_id", "text"), keep))
    hashed = rows.select("doc", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    joined = sized_join(hashed, classes, ["text_sha256"], row_bytes=128)
    alone = F.col("group_size").isNull()
    joined = joined.withColumn("owns", alone | F.col("doc_id").eqNullSafe(F.col("owner")))
    if not classes.where("n_owners > 1").isEmpty():
        several = F.col("owns") & F.coalesce(F.col("n_owners") > 1, F.lit(False))
        same = numbered(joined.where(several))
        first = durable(same.groupBy("text_sha256").agg(F.min("row_no").alias("first_row")))
        same = sized_join(same, first, ["text_sha256"], "inner", row_bytes=96, counts=classes.select("text_sha256", F.col("n_owners").alias("key_rows")))
        joined = joined.where(~several).unionByName(same.withColumn("owns", F.col("row_no") == F.col("first_row")).select(joined.columns))
    return joined.select(
        "doc.*",
        F.struct(
            F.when(alone, F.col("doc_id")).otherwise(F.col("owner")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
            F.col("owns").alias("kept"),
            F.col("text_sha256"),
        ).alias("dedup"),
    )


def exact_dedup(documents: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal byte for byte; null counts as empty, so null and empty texts are one group.  Of equal texts the row
    with the largest id stays (keep="min": the smallest), a null id only where all are null.  Among repeated rows with
    that same id one stays, so a group always keeps exactly one row.  Other columns are not read.
    """
    return marked(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), keep).select("doc_id", "dedup.*")
