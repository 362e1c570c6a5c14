import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def documents(spark, small):
    """The documents table and its rows."""
    df = spark.read.parquet(f"{small}/documents.parquet")
    return df, [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]
