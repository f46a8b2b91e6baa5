"""Importance resampling against a brute-force version."""

import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tests.llm import cases
from tidemark.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return w, [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def brute(rows, target):
    s, t = Counter(), Counter()
    each = [features(text) for _, text in rows]
    for _, f in each:
        s.update(f)
    for text in target:
        t.update(features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    scored = []
    for (i, _), (w, f) in zip(rows, each, strict=True):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= 20))
    able = sorted((x for x in scored if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, -x[1], -x[2]))
    rank = {id(x): n + 1 for n, x in enumerate(able[: 25 * len(able) // 100])}
    return sorted(((*x[:4], rank.get(id(x))) for x in scored), key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_documents_by_brute_force(spark, data):
    docs, target = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    assert found(importance.resample(docs, target)) == brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])


def test_awkward_rows(spark):
    table, rows = cases.awkward(spark)
    more = [(50 + i, f"Naïve\x00words  No. {i} " + "same-words À la carte ß " * 5) for i in range(9)] + [(None, "y " * 25)] * 2
    table = table.unionByName(spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True)
    goal = spark.createDataFrame([("same words here",), (None,), ("",)], "text string")
    for target, texts in ((goal, ["same words here", None, ""]), (goal.limit(0), [])):
        assert found(importance.resample(table, target)) == brute(rows + more, texts)
    assert importance.resample(cases.empty(spark), goal).collect() == []


def test_ranks_are_places_in_the_whole_order(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"))
    ranked = importance.placed(rows.repartition(16), F.desc("x")).collect()
    assert sorted((5000 - r.x, r["rank"]) for r in ranked) == [(i, i) for i in range(1, 5001)]
