"""The conversation trie against a brute-force version over lists."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import conversation_trie as ct

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, owner int, key string, node bigint"


def order(turn, role, text):
    told = f"{len(role.encode())}:{role}{text}".encode()
    return (turn is not None, turn or 0, hashlib.sha256(told).digest()[:16])


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: order(*t))
    walks = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c - 5 * int(c / 5))
        walks[c] = [t[1:] for t in own.get(base, [])[:h] + turns[h:]]
    members = defaultdict(list)
    for c in sorted(walks):
        for d in range(len(walks[c]) + 1):
            members[tuple(walks[c][:d])].append(c)
    saved = {n: (len(m) - 1) * len(n[-1][1].encode()) if n else 0 for n, m in members.items()}
    kids = defaultdict(int)
    for n in members:
        if n:
            kids[n[:-1]] += 1
    leaves, total = defaultdict(int), defaultdict(int)
    for n in members:
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            total[n[:d]] += saved[n]
    ends = lambda n, m: hashlib.sha256(",".join(str(c) for c in m if len(walks[c]) == len(n)).encode()).hexdigest()
    return sorted(((m[0], len(n), members[n[:-1]][0] if n else None, len(m), kids[n], leaves[n], total[n], ends(n, m)) for n, m in members.items()), key=str)


def found(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=str)


def test_table_by_brute_force(spark, data):
    table = spark.read.parquet(f"{data}/conversations.parquet")
    assert found(ct.conversation_trie(table)) == brute([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])


def random_rows(seed, n):
    """Few texts, so that conversations meet and part at many depths; null and repeated turns, absent bases, one long conversation."""
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-20, 4 * n), n):
        length = 400 if c == max(0, c) and not rows else r.randint(1, 14)
        for i in range(length):
            turn = r.choice([None, i, i, i, 3])
            rows.append((c, turn, r.choice(["user", "user", None]), r.choice(["a", "", None, "long text é"])))
    rows += rows[:7] + [(None, 0, "user", "x"), (None, None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("held", [50_000, 3])
def test_random_conversations(spark, held, monkeypatch):
    monkeypatch.setattr(ct, "HELD_NODES", held)
    rows = random_rows(held, 60)
    table = spark.createDataFrame([(*row, "x", 1, "k", 2) for row in rows], SCHEMA)
    truth = brute(rows)
    assert found(ct.conversation_trie(table)) == truth
    assert any(t[3] > 1 and t[1] > 3 for t in truth)


def test_small_tables(spark):
    assert ct.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    for rows in ([(None, 1, "a", "b")], [(7, 0, None, None)], [(0, 0, "r", "t"), (1, 0, "r", "t"), (3, 0, "r", "t")]):
        table = spark.createDataFrame([(*row, "x", 1, "k", 2) for row in rows], SCHEMA)
        assert found(ct.conversation_trie(table)) == brute(rows)


def test_ends_of_many_conversations_pass_in_order(spark):
    marks = spark.range(10_000).selectExpr("7L AS conv_id", "2L AS depth", "id * 3 - 5000 AS ended").repartition(7)
    ids = ",".join(str(i * 3 - 5000) for i in range(10_000))
    assert [r.ends_sha256 for r in ct._ends(marks, chunk=512).collect()] == [hashlib.sha256(ids.encode()).hexdigest()]
