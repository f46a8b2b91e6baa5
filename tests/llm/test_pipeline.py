"""The pipeline against a brute-force composition, and its stages' contract."""

import corpus_pipeline
from tests.llm.test_dedup import brute_classes
from tidemark.llm import toxicity
from tidemark.llm.pii import pseudonymise
from tidemark.llm.queries import PII_KEY


def test_run_by_brute_force(spark, data):
    import hashlib

    docs = spark.read.parquet(f"{data}/documents.parquet")
    score = {r.doc_id: r.score for r in toxicity.toxicity(docs, spark.read.parquet(f"{data}/labels.parquet")).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if score[r.doc_id] < 0.5)
    last = {t or "": i for i, t in rows}
    rows = [(i, t) for i, t in rows if last[t or ""] == i]
    rows = [row for n, (row, c) in enumerate(zip(rows, brute_classes(rows, 0.8), strict=True)) if n == c]
    secret = hashlib.blake2b(PII_KEY.encode(), digest_size=32).digest()
    expected = {i: pseudonymise(t, secret)[0] for i, t in rows if t is not None}
    found = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in found} == {i for i, _ in rows}
    from tests.llm.test_tokens import WORD_BPE, check_packing, native

    t = native(WORD_BPE)
    check_packing(found, {i: [*t.encode(expected.get(i, ""), add_special_tokens=False).ids, 0] for i, _ in rows}, 2048)


def test_stages_keep_the_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, data).schema.simpleString() == docs.schema.simpleString()
