import hashlib
import random
from collections import Counter, defaultdict

from tests.llm import cases
from tidemark.llm import exact_dedup, line_dedup, near_dedup
from tidemark.llm.exact_dedup import Patricia


def test_trie_against_a_dictionary():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(9))) for _ in range(3000)]
    trie, found = Patricia(), Counter()
    for i, t in enumerate(texts):
        trie.insert(t, (i, 0, True), 1)
        if trie.held > 200:  # spilled subtrees come back as further terminals of the same text
            for body, owner in trie.drain(100):
                found[body] += owner[1]
    for body, owner in trie.drain():
        found[body] += owner[1]
    assert found == Counter(texts)


def test_exact_groups_by_brute_force(spark):
    table, rows = cases.awkward(spark)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    for keep, pick in (("max", max), ("min", min)):
        for r in exact_dedup.exact_dedup(table, keep).collect():
            mine = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
            assert r.group_size == len(mine)
            assert r.keep_id == pick([i for i in mine if i is not None])
        kept = [r for r in exact_dedup.exact_dedup(table, keep).collect() if r.kept]
        assert len(kept) == len(groups) == len({r.text_sha256 for r in kept})


def test_exact_spills_and_still_counts_whole_groups(spark):
    texts = [f"{i % 7} " * (i % 11 + 1) for i in range(400)]
    table = cases.documents(spark, texts).selectExpr("doc_id", "text", "doc_id as row_no")
    found = exact_dedup.owners(table, held_bytes=64).collect()
    assert {r.text_sha256: r.group_size for r in found} == {hashlib.sha256(t.encode()).hexdigest(): n for t, n in Counter(texts).items() if n > 1}


def brute_lines(rows, least=20, enough=3):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for n, (_, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(n)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        lost = []
        for line in lines:
            owners = [rows[n][0] for n in holders.get(key(line), ())]
            known = [o for o in owners if o is not None]
            lost.append(len(owners) >= enough and bool(known) and (i is None or i < max(known)))
        out.append((i, len(lines), sum(lost), "\n".join(x for x, gone in zip(lines, lost, strict=True) if not gone)))
    return sorted(out, key=str)


def test_lines_by_brute_force(spark):
    rng = random.Random(3)
    pool = [f"{w} A Line Of Some Length {k}" for k in range(6) for w in ("", " \t", "É")] + ["short", "", "exactly twenty chars", "nineteen characters"]
    rows = [(i if i % 9 else None, rng.choice([None, "\n".join(rng.choices(pool, k=rng.randrange(1, 9)))])) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    parts = [spark.createDataFrame(rows[k::5], "doc_id bigint, text string") for k in range(5)]
    for batches in ([table], parts):
        found = line_dedup.drop_lines(table, batches).collect()
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found), key=str) == brute_lines(rows)


def test_runs_are_compacted_and_tell_what_is_unseen(spark):
    runs = line_dedup.LineRuns(enough=3, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(k, k, 0), (k, 7, 7)], "doc_id bigint, h1 bigint, h2 bigint"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    entries = {r.h1: (r.n_docs, r.top_id) for r in runs.entries().collect()}
    assert entries[7] == (5, 4) and entries[2] == (1, 2)
    new = spark.createDataFrame([(9, 7, 7), (9, 8, 8)], "doc_id bigint, h1 bigint, h2 bigint")
    assert [r.h1 for r in runs.unseen(new).collect()] == [8]


def shingles(text, k=5):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def brute_classes(rows, least):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            both = sum((x & y).values())
            if not x and not y or both and both >= least * (sum(x.values()) + sum(y.values()) - both):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(a) for a in range(len(rows))]


def mutated(rng, words, share):
    return [rng.choice("qrstuvw") * 4 if rng.random() < share else w for w in words]


def test_near_classes_by_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for g in range(25):
        base = [rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(rng.choice([3, 8, 60, 300]))]
        rows.append(" ".join(base))
        rows += [" ".join(mutated(rng, base, share)) for share in (0, 0.005, 0.01) for _ in range(g % 4)]
    rows += [None, "", "  ", "x", "X ", "repeat this " * 50, "repeat this " * 52, "repeat this " * 90]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    truth = brute_classes(rows, 0.8)
    found = {r.doc_id: r for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [found[i].class_id for i, _ in rows] == truth
    sizes = Counter(truth)
    assert all(found[i].class_size == sizes[c] and found[i].kept == (i == c) for (i, _), c in zip(rows, truth, strict=True))


def test_signature_agreement_estimates_weighted_jaccard():
    words = [f"w{i}" for i in range(400)]
    other = words[:200] + [f"v{i}" for i in range(200)]
    texts = [" ".join(words), " ".join(other)]
    of, strips, _ = near_dedup.elements(texts)
    s = near_dedup.signatures(of, strips, 2, 2048)
    x, y = map(shingles, texts)
    both = sum((x & y).values())
    assert abs((s[0] == s[1]).mean() - both / (sum(x.values()) + sum(y.values()) - both)) < 0.04


def test_classes_reach_through_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    assert {r.node: r.label for r in near_dedup.components(links).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_components_go_on_from_earlier_labels(spark):
    edge = lambda *rows: spark.createDataFrame(list(rows), "a bigint, b bigint")
    labels = near_dedup.components(edge((5, 4), (4, 3), (9, 8)))
    more = near_dedup.components(edge((9, 5), (2, 8), (7, 6), (4, 3)), labels)
    assert {r.node: r.label for r in more.collect()} == {2: 2, 3: 2, 4: 2, 5: 2, 8: 2, 9: 2, 6: 6, 7: 6}
    none = near_dedup.components(spark.createDataFrame([], "a bigint, b bigint"), labels)
    assert {r.node: r.label for r in none.collect()} == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8}


def test_large_groups_of_edited_copies_keep_all_their_links(spark):
    """Copies edited too far from most others, a passage that makes up most of many texts, and repeats of both."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    base, passage, rows = [word() for _ in range(90)], [word() for _ in range(170)], []
    for _ in range(160):
        copy = list(base)
        for at in rng.sample(range(90), rng.choice([1, 1, 2, 2, 3, 3, 4])):
            copy[at] = word()
        rows.append(" ".join(copy))
    for _ in range(60):
        own = [word() for _ in range(rng.randrange(8, 45))]
        rows += [" ".join(passage + own)] + [" ".join(passage + own[:-1])] * rng.randrange(2)
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    truth = brute_classes(rows, 0.8)
    assert 10 < len(set(truth)) < 150
    found = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [found[i] for i, _ in rows] == truth


def test_pairs_that_are_alike_always_meet():
    rng = random.Random(4)
    texts = [" ".join(rng.choices("ab", k=rng.randrange(5, 400))) for _ in range(60)]
    of, strips, _ = near_dedup.elements(texts)
    bits = near_dedup.sketches(of, strips, len(texts)).view("uint64")
    sets = [set(strips[of == i].tolist()) for i in range(len(texts))]
    for a in range(60):
        for b in range(a):
            apart = sum(int(x ^ y).bit_count() for x, y in zip(bits[a].tolist(), bits[b].tolist(), strict=True))
            assert apart <= len(sets[a] ^ sets[b])


def test_batches_are_all_rows_whatever_the_files(spark, tmp_path):
    table = spark.createDataFrame([(i if i % 5 else None, f"line {i}") for i in range(40)], "doc_id bigint, text string")
    for files in (1, 6):
        path = f"{tmp_path}/{files}"
        table.repartition(files).write.parquet(path)
        batches = line_dedup.batches_of(spark, path, 4)
        assert len(batches) == 4
        assert sorted(r.text for b in batches for r in b.collect()) == sorted(f"line {i}" for i in range(40))
