"""Every operator on awkward and on empty tables: one row per document, nothing lost, nothing raised."""

import pytest

from tests.llm import cases
from tidemark.llm import exact_dedup, fingerprints, html_extract, line_dedup, near_dedup, packing, pii, quality, tokens, toxicity
from tidemark.llm.queries import BYTE_BPE, PII_KEY, WORD_BPE

OPERATORS = {
    "near": lambda spark, d: near_dedup.near_classes(d),
    "fingerprints": lambda spark, d: fingerprints.fingerprints(d),
    "bpe": lambda spark, d: tokens.encode_decode(d, BYTE_BPE),
    "toxicity": lambda spark, d: toxicity.toxicity(d, cases.labels(spark, [(4, 1, 1), (3, 0, 0), (None, 1, 1), (6, None, None)])),
    "quality": lambda spark, d: quality.quality(d, cases.labels(spark, [(4, 1, 1), (3, 0, 0), (None, 1, 1), (6, None, None)])),
    "packing": lambda spark, d: packing.best_fit_pack(d, WORD_BPE).where("piece = 0"),
    "pii": lambda spark, d: pii.pii(d, PII_KEY),
    "exact": lambda spark, d: exact_dedup.exact_dedup(d),
    "lines": lambda spark, d: line_dedup.drop_lines(d, [d]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    table, rows = cases.awkward(spark)
    found = [r.doc_id for r in OPERATORS[name](spark, table).collect()]
    order = lambda ids: sorted(ids, key=lambda i: (i is None, i or 0))
    assert order(found) == order([i for i, _ in rows])


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, cases.empty(spark)).collect() == []


def test_no_labels_give_an_even_score(spark):
    table = cases.documents(spark, ["some text", None])
    for f in (toxicity.toxicity, quality.quality):
        assert {round(r.score, 6) for r in f(table, cases.labels(spark)).collect()} == {0.5}


def test_pages(spark):
    schema = "page_id bigint, url string, html string, text string, host string"
    assert html_extract.main_text(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, None, None, "t", None), (1, None, "", None, "h"), (None, "http://a.b/c", "<p>x", None, None), (2, "no url", "<" * 50, None, None)]
    found = html_extract.main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in found)[:2] == [("1", 0), ("1", 0)] and len(found) == 4
