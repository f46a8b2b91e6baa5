"""Near-duplicate classes by DartMinHash signatures, banded joining and an exact check of each link.

A document is the multiset of its shingles of five words: a shingle that occurs w times is an element with the weight
region [0, w), kept as w unit strips.  Darts fall on (strip, time) as a Poisson process drawn from hashes alone, the
same for every document.  A document with W strips looks at the darts on its strips up to time k (ln k + 2) / W, so it
sees about the same number whatever its length; each dart hits one of k coordinates, and the earliest on a coordinate
is the document's value there.  Two documents agree on a coordinate with the probability of their weighted Jaccard
similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, map_batches, numbered, sized_join
from tidemark.llm.wordhash import mix, words

_U = np.uint64
SHINGLE = 5
#: Pairs with one leader that a task compares, and members of a band bucket that a task compares with the others.
PAIRS_A_TASK, MEMBERS_A_TASK = 512, 2048
#: Bits of a text's sketch of strips, in words of 64.
SKETCH = 512
_FACTORS = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64))
#: Ends of the intervals in which a uniform 64-bit number makes 0, 1, 2, ... darts in a cell of unit size.
_POISSON = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 13)]))
_POISSON = (np.minimum(_POISSON, 1 - 2.0**-53) * 2.0**64).astype(np.uint64)


def elements(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of each unit strip of each text, in order of both; and two 64-bit hashes of each word sequence."""
    h, of = words(texts)
    n = len(h)
    starts = np.searchsorted(of, np.arange(len(texts)))
    counts = np.bincount(of, minlength=len(texts)) if n else np.zeros(len(texts), np.int64)
    place = (np.arange(n) - starts[of]).astype(np.uint64) if n else np.zeros(0, np.uint64)
    content = np.zeros((2, len(texts)), np.uint64)
    some = counts > 0
    for k in range(2):
        if n:
            content[k, some] = np.add.reduceat(mix(h * _U(2 * k + 3) + mix(place + _U(k * 7919 + 1))), starts[some])
    width = np.minimum(counts, SHINGLE)
    shingle = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        inside = np.arange(n) + k < (starts + counts)[of] if n else np.zeros(0, bool)
        shifted = np.zeros(n, np.uint64)
        shifted[: n - k] = h[k:]
        shingle += np.where(inside, shifted * _FACTORS[k], _U(0))
    whole = place.astype(np.int64) <= (counts - width)[of] if n else np.zeros(0, bool)
    of, shingle = of[whole], mix(shingle[whole])
    order = np.lexsort((shingle, of))
    of, shingle = of[order], shingle[order]
    if len(of):
        new = np.concatenate(([True], (of[1:] != of[:-1]) | (shingle[1:] != shingle[:-1])))
        run = np.arange(len(of)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        shingle = mix(shingle + mix(run.astype(np.uint64)) * (run > 0))
    return of, shingle, content


def signatures(of: np.ndarray, strips: np.ndarray, n_texts: int, k: int) -> np.ndarray:
    """The earliest dart on each of k coordinates of each text; texts without strips keep zeros."""
    signature = np.zeros((n_texts, k), np.uint64)
    weight = np.bincount(of, minlength=n_texts)
    horizon = k * (np.log(k) + 2) / np.maximum(weight, 1)
    open_ = weight > 0
    while open_.any():
        mine = open_[of]
        texts, el = of[mine], strips[mine]
        cells = np.ceil(horizon[texts]).astype(np.int64)
        at = np.repeat(np.arange(len(el)), cells)
        cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
        seed = mix(el[at] + mix(cell.astype(np.uint64) + _U(11)))
        n = np.searchsorted(_POISSON, seed, "right")
        dart = np.repeat(np.arange(len(seed)), n)
        nth = np.arange(len(dart)) - np.repeat(np.cumsum(n) - n, n)
        value = mix(seed[dart] + (nth.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))
        time = cell[dart] + (value & _U((1 << 40) - 1)).astype(np.float64) / (1 << 40)
        text = texts[at[dart]]
        seen = time < horizon[text]
        value, time, text = value[seen], time[seen], text[seen]
        coordinate = ((value >> _U(40)) * _U(k) >> _U(24)).astype(np.int64)
        latest = np.argsort(-time, kind="stable")
        flat, hit = signature.reshape(-1), np.zeros(n_texts * k, bool)
        where = text[latest] * k + coordinate[latest]
        flat[where] = mix(value[latest])  # the last to be written is the earliest
        hit[where] = True
        open_ &= ~hit.reshape(n_texts, k).all(1)
        horizon[open_] *= 2  # a coordinate that no dart hit: the same darts and later ones
    return signature


def bands(signature: np.ndarray, n_bands: int) -> np.ndarray:
    n, k = signature.shape
    rows = signature.reshape(n, n_bands, k // n_bands)
    out = np.broadcast_to(mix(np.arange(n_bands, dtype=np.uint64) + _U(101)), (n, n_bands)).copy()
    for r in range(rows.shape[2]):
        out = mix(out + rows[:, :, r])
    return out


def _signed(rows: DataFrame, n_bands: int, band_rows: int) -> DataFrame:
    """doc_id, row_no, weight, c1, c2 (the word sequence's hashes), bands."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(2).to_pylist()
            of, strips, content = elements(texts)
            b = bands(signatures(of, strips, len(texts), n_bands * band_rows), n_bands)
            weight = np.bincount(of, minlength=len(texts))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * n_bands, pa.int32()), pa.array(b.reshape(-1).view(np.int64)))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(weight, pa.int64()), pa.array(content[0].view(np.int64)), pa.array(content[1].view(np.int64)), lists],
                ["doc_id", "row_no", "weight", "c1", "c2", "bands"],
            )

        return apply

    return map_batches(rows, make, "doc_id bigint, row_no bigint, weight bigint, c1 bigint, c2 bigint, bands array<bigint>", rows=128)


def sketches(of: np.ndarray, strips: np.ndarray, n_texts: int) -> np.ndarray:
    """Of each text SKETCH parities of the number of its strips in a class.  Where two differ, the texts differ by a strip at least."""
    cell = of * SKETCH + (strips >> _U(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    odd = (np.bincount(cell, minlength=n_texts * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n_texts, SKETCH), axis=1).view(np.int64)


def _strips(rows: DataFrame) -> DataFrame:
    """row_no, the distinct hashes of its strips, their number and their sketch."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            of, strips, _ = elements(texts)
            ends = np.searchsorted(of, np.arange(len(texts) + 1))
            bits = sketches(of, strips, len(texts))
            columns = [
                batch.column(0),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(strips.view(np.int64))),
                pa.array(np.diff(ends), pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * bits.shape[1], pa.int32()), pa.array(bits.reshape(-1))),
            ]
            return pa.RecordBatch.from_arrays(columns, ["row_no", "strips", "weight", "bits"])

        return apply

    return map_batches(rows, make, "row_no bigint, strips array<bigint>, weight bigint, bits array<bigint>", rows=128)


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label) of every node of the links (a, b), the label being its component's smallest node.

    Labels fall to the smallest among the neighbours, then jump to their label's label; links through one leader
    settle in two rounds.  All steps are joins of distributed tables.  With labels, those of earlier links, only the
    components that the new links join are gone through again.
    """
    if labels is not None:
        joined = durable(_apart(links, labels).select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct())
        if joined.isEmpty():
            return labels
        moved = components(joined).select(F.col("node").alias("label"), F.col("label").alias("further"))
        old = sized_join(labels, moved, ["label"]).select("node", F.coalesce("further", "label").alias("label"))
        new = moved.select(F.col("label").alias("node"), F.col("further").alias("label"))
        return durable(old.union(sized_join(new, labels.select("node"), ["node"], "left_anti")))
    both = links.select("a", "b").union(links.select("b", "a"))
    labels = durable(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"), F.lit(True).alias("fell")))
    while not labels.where("fell").isEmpty():
        near = sized_join(both, labels.select(F.col("node").alias("b"), "label"), ["b"], "inner").groupBy("a").agg(F.min("label").alias("m"))
        fallen = labels.join(near, labels["node"] == near["a"]).select("node", "label", "m")
        jump = sized_join(fallen, labels.select(F.col("node").alias("label"), F.col("label").alias("further")), ["label"])
        low = F.least("m", "further")
        labels = durable(jump.select("node", F.least("label", low).alias("label"), (low < F.col("label")).alias("fell")))
    return labels.select("node", "label")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b, a_label, b_label of the pairs whose ends are in different components; a text without links is one of its own."""
    of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("a_label"))
    of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("b_label"))
    both = sized_join(sized_join(pairs, of_a, ["a"]), of_b, ["b"])
    both = both.select("a", "b", F.coalesce("a_label", "a").alias("a_label"), F.coalesce("b_label", "b").alias("b_label"))
    return both.where(F.col("a_label") != F.col("b_label"))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b), kept tables both, whose multisets of shingles have that weighted Jaccard similarity."""
    if pairs.isEmpty():
        return pairs
    # a leader that many texts have is dealt to as many tasks as its pairs fill, and copied to no more than those
    crowded = durable(pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS_A_TASK).alias("salts")).where("salts > 1"))
    salts = F.coalesce("salts", F.lit(1).cast("bigint"))
    of_b = sized_join(pairs.select("b").distinct(), crowded, ["b"], row_bytes=24).join(sets.select(F.col("row_no").alias("b"), F.col("strips").alias("other")), "b")
    of_b = of_b.select("b", "other", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"))
    dealt = sized_join(pairs, crowded, ["b"], row_bytes=24).select("a", "b", F.pmod(F.xxhash64("a"), salts).alias("salt"))
    held = dealt.join(sets.select(F.col("row_no").alias("a"), "strips"), "a")
    joined = held.join(of_b, ["b", "salt"])
    common = F.size(F.array_intersect("strips", "other"))
    return durable(joined.where(common >= least * (F.size("strips") + F.size("other") - common)).select("a", "b"))


def near_classes(documents: DataFrame, least: float = 0.8, n_bands: int = 30, band_rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, row_no, class_id, class_size, kept.

    Two texts are linked if they share a band and their weighted Jaccard similarity over shingles of five lower-cased
    words is at least `least`; classes are the connected components, class_id is the smallest doc_id of a class, and the
    first row of that id is the one kept.  A text of fewer than five words is one shingle; texts without words (null,
    empty, blank) form one class, as do texts with the same words in the same order, which are collapsed first.  Very
    long texts count whole.  Rows that repeat an id are documents of their own.  A null id is larger than all others.
    An empty table gives an empty result.  Other columns are not read.
    """
    rows = numbered(documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    return classes_of(rows, least, n_bands, band_rows)


def kept_rows(documents: DataFrame, least: float = 0.8, n_bands: int = 30, band_rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents, all columns, that `near_classes` keeps: one row of each class."""
    rows = numbered(documents.select(F.struct("*").alias("doc")))
    plain = rows.select(F.col("doc")[id_col].cast("bigint").alias("doc_id"), "row_no", F.coalesce(F.col("doc")[text_col], F.lit("")).alias("text"))
    kept = durable(classes_of(plain, least, n_bands, band_rows).where("kept").select("row_no"))
    return sized_join(rows, kept, ["row_no"], "left_semi", row_bytes=16).select("doc.*")


def classes_of(rows: DataFrame, least: float, n_bands: int, band_rows: int) -> DataFrame:
    """`near_classes` of a table of doc_id, text and row_no that every scan reads alike."""
    signed = durable(_signed(rows.select("doc_id", "row_no", "text"), n_bands, band_rows))
    texts = durable(signed.groupBy("c1", "c2").agg(F.min("row_no").alias("row_no"), F.count("*").alias("n_rows")))
    first = signed.join(texts.select("row_no"), "row_no", "left_semi").select("row_no", "weight", "bands")
    labels = _linked(durable(first), rows, least)
    by_text = texts.join(labels, texts["row_no"] == labels["node"], "left").select("c1", "c2", "n_rows", F.coalesce("label", "row_no").alias("class_no"))
    by_text = durable(by_text)
    in_class = durable(sized_join(signed.select("doc_id", "row_no", "c1", "c2"), by_text.drop("n_rows"), ["c1", "c2"], "inner", counts=by_text.select("c1", "c2", F.col("n_rows").alias("key_rows"))).select("doc_id", "row_no", "class_no"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("row_no").alias("row_no"))
    classes = in_class.groupBy("class_no").agg(F.min(order).alias("best"), F.count("*").alias("class_size"))
    many = durable(classes.where(F.col("class_size") > 1))
    joined = sized_join(in_class, many, ["class_no"], counts=many.select("class_no", F.col("class_size").alias("key_rows")))
    return joined.select(
        "doc_id",
        "row_no",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("bigint")).alias("class_size"),
        (F.col("best").isNull() | (F.col("best.row_no") == F.col("row_no"))).alias("kept"),
    )


def _linked(first: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """(node, label) of the texts that links of at least `least` join: the components over all links inside the band buckets.

    Leaders come first, as most of a bucket is linked to its leader: each text with the smallest leader of its buckets,
    then with those of other components.  What is left are buckets that hold several components; `_across` looks for
    links between them.
    """
    member = first.where(F.col("weight") > 0).select("row_no", "weight", F.explode("bands").alias("bucket"))
    leaders = member.groupBy("bucket").agg(F.min(F.struct("row_no", "weight")).alias("leader"), F.count("*").alias("n"))
    leaders = durable(leaders.where(F.col("n") > 1).select("bucket", F.col("leader.row_no").alias("b"), F.col("leader.weight").alias("b_weight"), "n"))
    members = durable(sized_join(member.withColumnRenamed("row_no", "a"), leaders.drop("n"), ["bucket"], "inner", row_bytes=48, counts=leaders.select("bucket", F.col("n").alias("key_rows"))))
    needed = durable(members.select(F.col("a").alias("row_no")).distinct())
    sets = durable(_strips(sized_join(rows.select("row_no", "text"), needed, ["row_no"], "left_semi", row_bytes=16)))
    alike = F.least("weight", "b_weight") >= least * F.greatest("weight", "b_weight")
    pairs = durable(members.where((F.col("a") != F.col("b")) & alike).select("a", "b").distinct())
    nearest = durable(pairs.groupBy("a").agg(F.min("b").alias("b")))
    labels = components(_verified(nearest, sets, least))
    rest = durable(_apart(pairs.join(nearest, ["a", "b"], "left_anti"), labels).select("a", "b"))
    labels = components(_verified(rest, sets, least), labels)
    return _across(members.select("bucket", "a"), sets, labels, least)


def _mixed(members: DataFrame) -> DataFrame:
    """The rows of buckets that hold several labels."""
    several = members.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return members.join(several.select("bucket"), "bucket", "left_semi")


def _fits(x: str, y: str, least: float):
    """Whether two texts of different components can be that similar; no pair that is fails.

    They share no more strips than the smaller number that either shares with other components at all, and they differ
    in as many strips as their sketches differ in bits.
    """
    of = lambda name: (F.col(f"{x}.{name}"), F.col(f"{y}.{name}"))
    (s, t), (v, w) = of("shared"), of("weight")
    by_strips = F.least(s, t) >= least * (v - s + w - t + F.greatest(s, t)) - 1e-6
    apart = sum((F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(1, SKETCH // 64)), F.bit_count(F.col(f"{x}.bits")[0].bitwiseXOR(F.col(f"{y}.bits")[0])))
    return by_strips & (apart <= (1 - least) / (1 + least) * (v + w) + 1e-6)


def _across(members: DataFrame, sets: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Labels after all links between components that share a bucket.

    Strips that no other component has cannot be in a link, so a text that shares fewer than `least` of its strips has
    none.  Of the others, the one of a bucket with the fewest strips of its own is the bucket's centre: edited copies of
    one text are linked to it if to any.  All are compared with the centre; texts that then still are in different
    components meet if `_fits` leaves a link possible.  A bucket of many members is split over tasks.
    """
    tagged = sized_join(members, labels.select(F.col("node").alias("a"), "label"), ["a"]).select("bucket", "a", F.coalesce("label", "a").alias("label"))
    tagged = durable(_mixed(tagged))
    label = durable(tagged.select("a", "label").distinct())
    mine = durable(sized_join(sets.select(F.col("row_no").alias("a"), "strips", "weight", "bits"), label, ["a"], "inner", row_bytes=24))
    each = mine.select("a", "label", F.explode("strips").alias("strip"))
    common = durable(each.groupBy("strip").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("strip"))
    shared = sized_join(each, common, ["strip"], "left_semi", row_bytes=16).groupBy("a").agg(F.count("*").alias("shared"))
    able = durable(mine.select("a", "weight", "bits").join(shared, "a").where(F.col("shared") >= least * F.col("weight") - 1e-6))
    open_ = durable(_mixed(sized_join(tagged, able, ["a"], "inner", row_bytes=128)))
    centre = open_.groupBy("bucket").agg(F.min_by(F.struct("a", "label", "weight", "shared", "bits"), F.struct(F.col("weight") - F.col("shared"), "a")).alias("c"), F.count("*").alias("n"))
    centre = durable(centre.select("bucket", "c.*", "n"))
    to_centre = sized_join(open_.alias("x"), centre.alias("y"), ["bucket"], "inner", row_bytes=128, counts=centre.select("bucket", F.col("n").alias("key_rows")))
    to_centre = to_centre.where((F.col("x.label") != F.col("y.label")) & _fits("x", "y", least))
    tried = durable(to_centre.select(F.col("x.a").alias("a"), F.col("y.a").alias("b")).distinct())
    labels = components(_verified(tried, sets, least), labels)
    again = sized_join(open_.drop("label"), labels.select(F.col("node").alias("a"), "label"), ["a"]).withColumn("label", F.coalesce("label", "a"))
    again = durable(_mixed(again))
    blocks = durable(again.groupBy("bucket").agg(F.ceil(F.count("*") / MEMBERS_A_TASK).alias("blocks")).where("blocks > 1"))
    cut = sized_join(again, blocks, ["bucket"], row_bytes=24).withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
    x = cut.withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks"))).alias("x")
    y = cut.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).alias("y")
    meet = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.a") < F.col("y.a")) & (F.col("x.label") != F.col("y.label"))
    left = x.join(y, meet & _fits("x", "y", least)).select(F.col("y.a").alias("a"), F.col("x.a").alias("b")).distinct()
    return components(_verified(durable(left), sets, least), labels)
