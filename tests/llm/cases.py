"""Small document tables with the awkward cases that every text operator must take."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, row_no int, score string, label int, bucket string, doc string, salt int, body string"
LONG = "one two three four five six seven eight nine ten eleven twelve. " * 2000


def documents(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", None if t is None else len(t), "k", 1, None, 2, "b", "d", 3, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Null and empty texts, a null id, repeated rows, ties, one very long text, null values elsewhere, clashing columns."""
    texts = [None, "", " \n\t", "a", "same words in the same text here", "same words in the same text here", LONG, "x\n\ny\n"]
    rows = [(i, t, None, None, None, None, None, None, None, None, None, None, None) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "same words in the same text here", *[None] * 11), (None, None, *[None] * 11)]
    return spark.createDataFrame(rows, SCHEMA), [(r[0], r[1]) for r in rows]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")
