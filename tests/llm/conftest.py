import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from samples import edge_texts  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, tag string, score string, seq int, part string, shard string, label int, hub string, spans int"


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(d, t, "en", "s", None if t is None else len(t), d % 3, "t", "0", 1, "p", "s", 1, "h", 2) for d, t in edge_texts()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def with_null_id(edge):
    return edge.unionByName(edge.where("doc_id = 1").selectExpr("cast(null as long) as doc_id", *edge.columns[1:]))


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return [tuple(r) for r in documents.select("doc_id", "text").collect()]
