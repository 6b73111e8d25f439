import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from llm_rows import DOCS  # noqa: E402


@pytest.fixture(scope="session")
def documents(spark, tmp_path_factory):
    """Writes rows ``(doc_id, text[, source])`` as a documents table and reads it back."""
    def make(rows, *extra):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        spark.createDataFrame(full, DOCS).coalesce(1).write.parquet(path)
        docs = spark.read.parquet(path)
        return docs.withColumns({c: F.lit("x") for c in extra})

    return make

