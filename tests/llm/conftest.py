import random

import pytest

from parcelframe.llm.common import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use inside, as extra columns of their inputs
CLASH = ["score", "set", "node", "n", "k", "rank", "shard", "size", "part", "_maybe", "key"]


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdeghilmnoprstuy") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def clash(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(1).alias(c) for c in CLASH])


def docs_of(spark, texts, ids=None, sources=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", (sources or ["s0", "s1", None])[k % len(sources or [0, 0, 0])], len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)
