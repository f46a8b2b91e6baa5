"""Prefix trie of rebuilt conversations: a small trie a family, then a merge of family nodes only."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import durable, sized_join

#: Family nodes that a task holds before it lets them go; parts of one node are added up in the merge.
HELD_NODES = 50_000
NODES = "node binary, depth bigint, n_bytes bigint, members array<bigint>, ends array<bigint>"
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame, family: int) -> DataFrame:
    """family_id, conv_id, turn, key (16 bytes that stand for role and text), n_bytes of the text.  Texts go no further than this."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("bigint")
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    key = F.substring(F.unhex(F.sha2(told.cast("binary"), 256)), 1, 16)
    return conversations.where(conv.isNotNull()).select((conv - conv % family).alias("family_id"), conv.alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), key.alias("key"), F.octet_length(text).cast("bigint").alias("n_bytes"))


class FamilyTrie:
    """The trie of one family's rebuilt conversations, grown turn by turn.

    A node is told by a digest chained over its turns, so that the same prefix has the same digest in every family.
    A conversation is one walk from the root; only the head of the family's base is kept for the others.
    """

    def __init__(self, head_of: Callable[[int], int], most_head: int):
        self.head_of, self.most_head = head_of, most_head
        self.nodes: dict[bytes, list] = {}
        self.family = self.conv = None
        self.head: list[tuple[bytes, int]] = []

    def _visit(self) -> None:
        self.nodes.setdefault(self.at, [self.depth, self.last_bytes, [], []])[2].append(self.conv)

    def _step(self, key: bytes, n_bytes: int) -> None:
        self.at = hashlib.blake2b(self.at + key, digest_size=16).digest()
        self.depth, self.last_bytes = self.depth + 1, n_bytes
        self._visit()

    def open(self, family: int, conv: int) -> None:
        if family != self.family:
            self.family, self.head = family, []
        self.conv, self.place, self.skip = conv, 0, 0
        self.at, self.depth, self.last_bytes = b"", 0, 0
        self._visit()
        if conv != family:
            self.skip = self.head_of(conv)
            for key, n_bytes in self.head[: self.skip]:
                self._step(key, n_bytes)

    def turn(self, key: bytes, n_bytes: int) -> None:
        if self.conv == self.family and self.place < self.most_head:
            self.head.append((key, n_bytes))
        if self.place >= self.skip:
            self._step(key, n_bytes)
        self.place += 1

    def close(self) -> None:
        """Mark where the conversation ends; a node let go meanwhile comes once more, without its member."""
        if self.conv is not None:
            self.nodes.setdefault(self.at, [self.depth, self.last_bytes, [], []])[3].append(self.conv)

    def drain(self) -> pa.RecordBatch:
        rows = self.nodes.items()
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([n for n, _ in rows], pa.binary()),
                pa.array([x[0] for _, x in rows], pa.int64()),
                pa.array([x[1] for _, x in rows], pa.int64()),
                pa.array([x[2] for _, x in rows], pa.list_(pa.int64())),
                pa.array([x[3] for _, x in rows], pa.list_(pa.int64())),
            ],
            ["node", "depth", "n_bytes", "members", "ends"],
        )
        self.nodes = {}
        return batch


def _tries(modulus: int, held: int):
    """Families arrive sorted, the base first, each conversation in order of its turns; one conversation's rows pass one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = FamilyTrie(lambda c: zlib.crc32(str(c).encode()) % modulus, modulus - 1)
        for batch in batches:
            families, convs, keys, sizes = (batch.column(c).to_pylist() for c in ("family_id", "conv_id", "key", "n_bytes"))
            for family, conv, key, n_bytes in zip(families, convs, keys, sizes, strict=True):
                if conv != trie.conv:
                    trie.close()
                    if len(trie.nodes) >= held:
                        yield trie.drain()
                    trie.open(family, conv)
                trie.turn(key, n_bytes)
                if len(trie.nodes) >= 2 * held:
                    yield trie.drain()
        trie.close()
        yield trie.drain()

    return run


def family_nodes(turns: DataFrame, modulus: int) -> DataFrame:
    """The nodes of all families' tries with their members and the conversations that end there, both of the family alone."""
    order = ["family_id", F.col("conv_id") != F.col("family_id"), "conv_id", F.col("turn").asc_nulls_first(), "key"]
    dealt = turns.repartition("family_id").sortWithinPartitions(*order).select("family_id", "conv_id", "key", "n_bytes")
    return dealt.mapInArrow(_tries(modulus, HELD_NODES), NODES)


def _ends(marks: DataFrame, chunk: int = 4096) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes where conversations end.  marks: conv_id, depth, ended.

    Ids meet in chunks of neighbouring ids first; a node's chunks then pass one hash in order, as SHA-256 asks, without
    ever being held together.
    """
    chunks = marks.groupBy("conv_id", "depth", F.floor(F.col("ended") / chunk).alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("ended")), lambda i: i.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            found = []
            for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
                if (conv, depth) == at:
                    digest.update(b",")
                else:
                    if at:
                        found.append((*at, digest.hexdigest()))
                    at, digest = (conv, depth), hashlib.sha256()
                digest.update(ids.encode())
            yield out(found)
        yield out([(*at, digest.hexdigest())] if at else [])

    def out(found: list) -> pa.RecordBatch:
        columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "depth", "ends_sha256"])

    dealt = chunks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "chunk")
    return dealt.select("conv_id", "depth", "ids").mapInArrow(run, "conv_id bigint, depth bigint, ends_sha256 string")


def conversation_trie(conversations: DataFrame, family: int = 5, modulus: int = 9) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c is rebuilt as the first h original turns of the base conversation c - c % family (all if fewer, none
    if it is absent), followed by its own turns after its first h; h = crc32(decimal c) % modulus.  A node is a distinct
    sequence of first turns, (conv_id, depth) tells it, conv_id being its smallest member.

    Turns go by number, a null number first; turns of one number go by the first 16 bytes of the SHA-256 of role and
    text, so repeated rows are turns of their own and their order does not matter.  Null role or text is empty.  Rows
    without conv_id belong to no conversation and are left out.  An empty table has no nodes, not even a root.  Other
    columns are not read.

    Families are rebuilt and made into tries one after the other as a task reads its sorted rows; a task holds some
    50,000 nodes at most, a long conversation passes turn by turn.  Nodes of several conversations (`shared`) are merged
    over families.  Everything summed over a subtree is a sum over the members of its top: each distinct node counts for
    its smallest member, its owner, and a member owns all nodes of its path below the first that it owns.
    """
    nodes = durable(family_nodes(turns_of(conversations, family), modulus))
    sizes = (F.size("members").cast("bigint"), F.size("ends").cast("bigint"))
    merged = nodes.groupBy("node").agg(F.sum(sizes[0]).alias("n_convs"), F.sum(sizes[1]).alias("n_ends"), F.min(F.array_min("members")).alias("owner"), F.count("*").alias("key_rows"))
    shared = durable(merged.where(F.col("n_convs") > 1))
    counts = shared.select("node", "key_rows")
    # a part that came after its node was let go has no member of its own, only ends
    placed = sized_join(nodes, shared.drop("key_rows"), ["node"], row_bytes=64, counts=counts)
    alone = F.coalesce(F.array_min("members"), F.element_at("ends", 1))
    placed = durable(placed.select("depth", "n_bytes", "members", "ends", F.coalesce("owner", alone).alias("owner"), "n_convs", (F.col("n_ends") == F.col("n_convs")).alias("childless")))

    many = placed.where(F.col("n_convs").isNotNull())
    walks = many.select("depth", "n_bytes", "owner", "childless", F.explode("members").alias("member"), "ends")
    ended = many.select("depth", "owner", F.explode("ends").alias("member")).withColumn("ended", F.lit(True))
    walks = walks.drop("ends").join(ended, ["depth", "owner", "member"], "left").withColumn("ended", F.coalesce("ended", F.lit(False)))
    path = Window.partitionBy("member")
    foreign = F.col("owner") != F.col("member")
    walks = walks.select(
        "*",
        F.max(F.when(foreign, F.col("depth"))).over(path).alias("last_foreign"),
        F.max(F.when(foreign, F.struct("depth", "owner"))).over(path)["owner"].alias("attached_to"),
        F.max(F.col("ended") & (~F.col("childless") | foreign)).over(path).alias("no_leaf"),
        F.sum(F.when(foreign, F.col("n_bytes")).otherwise(0)).over(path.orderBy(F.desc("depth"))).alias("spared"),
    )
    below = F.coalesce("last_foreign", F.lit(-1))
    sums = walks.groupBy(F.col("owner").alias("conv_id"), "depth").agg(
        F.sum((~F.col("ended") & (F.col("depth") >= below)).cast("bigint")).alias("n_children"),
        F.sum((~F.col("no_leaf")).cast("bigint")).alias("n_leaves"),
        F.sum("spared").alias("saved_tokens"),
        F.count("*").alias("n_convs"),
    )
    # the first node that a member owns hangs below the last that it does not
    hung = walks.where((F.col("depth") == F.col("last_foreign")) & ~F.col("ended")).select(F.col("member").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("attached_to").alias("parent_conv_id"))
    few = placed.where(F.col("n_convs").isNull())
    few = few.groupBy(F.col("owner").alias("conv_id"), "depth").agg((1 - F.sum(F.size("ends"))).cast("bigint").alias("n_children"))
    few = few.select("*", F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"), F.lit(1).cast("bigint").alias("n_convs"))
    hashes = _ends(placed.select(F.col("owner").alias("conv_id"), "depth", F.explode("ends").alias("ended")))
    facts = sums.unionByName(few).unionByName(hung, allowMissingColumns=True).unionByName(hashes, allowMissingColumns=True)
    first = ["parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = facts.groupBy("conv_id", "depth").agg(*[F.max(c).alias(c) for c in first])
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id"))
    return whole.withColumns({"parent_conv_id": parent, "ends_sha256": F.coalesce("ends_sha256", F.lit(EMPTY_SHA256))}).select("conv_id", "depth", *first)
