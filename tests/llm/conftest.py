import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_rows():
    """Ids, texts and columns that have tripped such operators: nulls, blanks, repeats, one very long text."""
    r = random.Random(3)
    long = " ".join(r.choice("abcdefghij") + str(r.randrange(4000)) for _ in range(30_000))
    return [
        (1, "One line\nand another one here\nand a third"), (2, None), (3, ""), (4, " \n\t "), (5, long), (5, long), (6, "x" * 3000),
        (None, "no id here"), (None, None), (7, "One line\nand another one here\nand a third"), (7, "same id, other text"), (8, "über Straße\x00 naïve  “quoted” 你好"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The same with more columns, named like the operators' own."""
    rows = [(i, t, f"h{k}", k, [k], True) for k, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, hash string, n_words long, words array<int>, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
