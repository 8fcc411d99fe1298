import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names the operators use for themselves.
CLASHING = ("key", "doc", "sub", "at", "rest", "terms", "label", "node", "size", "shard", "fp", "_id", "_label", "_s", "part", "tie", "d0", "c0", "words", "bins", "_drop", "_hit", "t0", "t1", "digest", "prefix", "sketch", "row", "item", "ends", "h", "n", "k", "length", "rank", "offset", "s1", "tfs", "number", "dim", "w")


def corpus(seed: int = 3, n: int = 60) -> list[tuple]:
    """Invented documents with copies, near copies, shared passages, nulls, empty and long texts."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgéß") for _ in range(r.randint(2, 8))) for _ in range(300)]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage = say(30)
    rows = []
    for i in range(n):
        text = say(r.randint(0, 80)).capitalize()
        if i % 7 == 0:
            text += "\n" + passage + ".\n" + say(5)
        if i % 11 == 0 and rows:
            text = rows[-1][1]
        if i % 13 == 0 and rows and rows[-2][1]:
            text = rows[-2][1] + " " + r.choice(vocab)
        rows.append((i, text, "en", f"s{i % 3}", len(text or "")))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, " \n\t ", "en", "s", 4), (1003, "Wörter ÄÖ. Ünder 'S it's", "de", "s", 5), (None, say(40), "en", "s", 1)]
    rows += [(1004, say(3000), "en", "s", 9), (1005, "a" * 5000, "en", "s", 9), rows[5], rows[5]]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with columns of clashing names beside its own."""
    df = spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
