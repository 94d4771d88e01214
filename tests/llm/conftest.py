import random

import pytest

from pyspark.sql import types as T

#: Columns with names that operators use inside.
EXTRA = ["n", "k1", "band", "bits", "block", "bucket", "slot", "place", "label", "kind", "y", "_bins", "ids_", "score"]


def words(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def odd_rows(seed=3):
    """Nulls, blanks, short, very long, equal and nearly equal texts, shared passages, repeated rows."""
    r = random.Random(seed)
    passage, base = words(r, 60), words(r, 120).split()
    rows = [(1, None, None), (2, "", "a"), (3, " \t\n ", "a"), (4, "one", "b"), (5, "one two three four", "b"), (6, "ONE two\tthree four", "b"),
            (7, "ÀÉ ü 中文 🙂 it's", None), (8, words(r, 9000), "a"), (9, "x" * 20000, "a"), (10, "w " * 300, "c")]
    for i in range(20, 40):
        near = list(base)
        near[r.randrange(len(near))] = f"edit{i}"
        rows.append((i, " ".join(near), "hot"))
    rows += [(i, " ".join(base), "hot") for i in range(40, 60)]
    rows += [(i, f"{words(r, 30)} {passage} {words(r, r.randrange(30))}", "hot") for i in range(60, 80)]
    rows += [(i, words(r, r.randrange(1, 90)), r.choice("abc")) for i in range(80, 110)]
    return rows + rows[10:12]


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with further columns whose names operators use."""
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
