"""Results do not depend on how a scan is split, even if that changes from one scan to the next; what articles share stays."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, exact_dedup, fingerprints, html_extract, line_dedup, near_dedup, quality, simhash, toxicity

OPERATORS = {
    "pages": lambda d: html_extract.main_text(d.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h"), F.col("doc_id") % 2).alias("url"), F.concat(F.lit("<main><p>advert on all</p><p>"), "text").alias("html"))),
    "near": lambda d: near_dedup.near_classes(d).drop("row_no"),
    "kept": lambda d: near_dedup.kept_rows(d),
    "fingerprints": lambda d: fingerprints.fingerprints(d),
    "exact": lambda d: exact_dedup.exact_dedup(d),
    "lines": lambda d: line_dedup.drop_lines(d, [d]),
    "simhash": lambda d: simhash.simhash_components(d),
}


@pytest.fixture(scope="module")
def many_files(spark, data, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("scans") / "documents")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    again = docs.where("doc_id % 5 = 0")
    docs.union(again).union(again).repartition(24).write.parquet(folder)
    return folder


@pytest.mark.parametrize("name", OPERATORS)
def test_scans_may_be_split_anew(spark, many_files, monkeypatch, name):
    calls = iter(range(10_000))
    knobs = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes")

    def turn(df, *a, f=common.durable, **b):
        out = f(df, *a, **b)
        spark.conf.set(knobs[0], str((1, 16, 5)[next(calls) % 3]))
        spark.conf.set(knobs[1], ("4m", "1", "64k")[next(calls) % 3])
        return out

    def result():
        return sorted(map(str, OPERATORS[name](spark.read.parquet(many_files)).collect()))

    plain = result()
    for module in (common, exact_dedup, fingerprints, html_extract, line_dedup, near_dedup, simhash):
        if hasattr(module, "durable"):
            monkeypatch.setattr(module, "durable", turn)
    try:
        assert result() == plain
        assert next(calls) > 0 or name == "fingerprints"
    finally:
        for k in knobs:
            spark.conf.unset(k)


def page(i, body):
    return (i, f"https://news.example/{i}", f"<html><body><main><div><h1>{body[0]}</h1></div>{''.join(f'<p>{b}</p>' for b in body[1:])}<div class=q7><p>Get our app today, it is free.</p></div></main></body></html>")


def test_articles_keep_what_they_share(spark):
    own = lambda i: f"Paragraph number {i} of an article that no other page of this host has."
    shared, licence, quote = "A first line that many articles share", "Released under the MIT License.", "To be or not to be, that is the question."
    bodies = []
    for i in range(20):
        body = [shared if i < 12 else f"Title {i}", own(i)]
        body += [licence] if i % 4 == 0 else []
        body += [quote, own(100 + i)] if i % 5 == 0 else []
        body += [shared] if 8 <= i < 19 else []
        bodies.append(body)
    rows = [page(i, b) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows + rows[:3], "page_id bigint, url string, html string")
    found = sorted((r.page_id, r.text) for r in html_extract.main_text(df).collect())
    assert found == sorted((i, "\n".join(b)) for i, b in [*enumerate(bodies), *enumerate(bodies[:3])])


def test_no_template_below_the_share(spark):
    rows = [page(i, [f"Title {i}", f"Only paragraph of article {i}, long enough to be the longest."]) for i in range(2)]
    texts = [r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()]
    assert all("Get our app" in t for t in texts)


def test_labels_without_documents_take_no_place(spark):
    docs = spark.createDataFrame([(i, f"words of {'bad' if i % 2 else 'good'} text {i}") for i in range(20)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(5000)], "doc_id bigint, quality int, toxic int")
    assert toxicity.labelled(docs, labels, 50, "doc_id", "text", "toxic").count() == 20
    assert toxicity.labelled(docs, labels, 7, "doc_id", "text", "toxic").count() == 7
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.train(docs, labels)).collect()}
    assert all((s > 0.5) == (i % 2 == 1) for i, s in scores.items())
    assert len(quality.train(docs, labels)["labels"]) == 20
