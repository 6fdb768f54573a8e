"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

DOCS = "doc_id bigint, text string, spans string, n_words int, score double, `row` string, node bigint, h string"


def documents(spark, texts, first=0):
    rows = [(first + k, t, "x", 1, 0.5, "r", k, "h") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", " \n\t ", "a", "É é\x00\x1f.", "word " * 30_000, "word " * 30_000]
