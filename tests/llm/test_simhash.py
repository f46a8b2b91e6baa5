"""SimHash fingerprints, plane comparison and components against brute force."""

import random

import numpy as np
import xxhash

from tests.llm import cases
from tidemark.llm import simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """(doc_id, fingerprint, component_id) by comparison of all with all."""
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(d, low.get(top(i), d))
    return sorted(((d, f"{fps[i]:016x}", low.get(top(i))) for i, (d, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_documents_by_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert found(simhash.simhash_components(docs)) == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_awkward_rows(spark):
    table, rows = cases.awkward(spark)
    rows = rows + []
    assert found(simhash.simhash_components(table)) == brute_components(rows)
    assert simhash.simhash_components(cases.empty(spark)).collect() == []


def test_fingerprint_of_few_and_odd_words():
    for text in ["", " \t", "A", "a B", "a b c", "É é x y z w", "a\x1cb c d", "x\x0by\x0cz q", "a a a a a a"]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def near_numbers(n, seed):
    """Numbers in clusters of steps of a few bits, some of which chain clusters together."""
    r = random.Random(seed)
    numbers = {0, (1 << 64) - 1}
    while len(numbers) < n:
        x = r.choice(sorted(numbers)) if r.random() < 0.7 else r.getrandbits(64)
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.randrange(64)
        numbers.add(x)
    return sorted(numbers)


def test_planes_find_all_links():
    fps = np.array(near_numbers(300, 1), np.uint64)
    cells = np.sort(np.random.RandomState(0).randint(0, 4, len(fps)))
    for radius in (0, 1, 3, 4, 7):
        member, word, lanes = simhash.PlaneCells(fps, cells).near(radius)
        planes = simhash.PlaneCells(fps, cells)
        pairs = set()
        for m, w, bits in zip(member.tolist(), word.tolist(), lanes.tolist(), strict=True):
            base = planes.first[planes.cell[m]] + (w - planes.word_of[planes.cell[m]]) * 64
            pairs |= {(m, int(base) + b) for b in range(64) if bits >> b & 1}
        true = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if i != j and cells[i] == cells[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
        assert pairs == true


def joined(pairs, nodes):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        parent[top(a)] = top(b)
    return {n: top(n) for n in nodes}


def same(x, y):
    return len(set(x.values())) == len(set(y.values())) == len({(x[n], y[n]) for n in x})


def test_crowded_cells_are_split_without_loss(spark, monkeypatch):
    numbers = near_numbers(400, 2)
    df = spark.createDataFrame([(simhash.signed(x),) for x in numbers], "fp bigint")
    true = joined([(a, b) for i, a in enumerate(numbers) for b in numbers[:i] if (a ^ b).bit_count() <= 3], numbers)
    for cell in (1024, 6):
        monkeypatch.setattr(simhash, "CELL", cell)
        pairs = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(df).collect()]
        assert same(joined(pairs, numbers), true)
        assert len(pairs) < 25 * len(numbers)
