"""Small tables with the awkward rows that every operator has to take."""

import random

WORDS = "the of and river stone light over under paper house green walk seven trade north field letter music round clear".split()
DOCS = "doc_id long, text string, doc string, value long, n_chars long"


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(40)) if rng.random() < 0.5 else "") for _ in range(n))


def documents(spark, texts, start=0):
    """Rows with ids in order and extra columns whose names operators also use inside."""
    rows = [(start + i, t, "x", i, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    long = prose(9000, 1)
    texts = [None, "", " \n\t ", "one", "Zwölf Boxkämpfer\njagen", long, long, "a b " * 300, "日本語 😀 text", prose(60, 2), prose(60, 2)]
    rows = documents(spark, texts)
    return rows.unionByName(spark.createDataFrame([(None, prose(30, 3), None, None, None)], DOCS))


def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(frame, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in frame.collect()}
