import random

import pytest

EDGE_TEXTS = [
    None, "", " \n\t ", "one", "one", "É Straße Σς <|endoftext|>. 😀 x́.", "İ. ǅ ﬁ ▁ sign",
    "mail a.b@c.example.org or +1 (958) 555-1762 4524132264652876 end", "word " * 5000, "x" * 20000,
    "Same words in this line here again.\nSame words in this line here again.\n" * 3, "a  b   c ",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and columns with clashing names."""
    rows = [(i, t, i * 2, f"p{i}", i) for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[7], rows[3], (None, "row without id", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score long, print string, quality_score long")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture(scope="session")
def prose(spark):
    """Sentences from a small vocabulary, with copies and near copies."""
    r = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("n", "rt", "sel")]
    texts = []
    for i in range(160):
        if i % 8 == 7:
            old = texts[r.randrange(len(texts))].split(" ")
            if r.random() < 0.5:
                old[r.randrange(len(old))] = "changed"
            texts.append(" ".join(old))
        else:
            texts.append(" ".join(r.choice(words) + ("." if r.random() < 0.1 else "") for _ in range(r.randint(3, 300))))
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


def local(df):
    return df.toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True)
