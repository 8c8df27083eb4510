import pytest
from pyspark.sql import types as T

LONG, TEXT, INT = T.LongType(), T.StringType(), T.IntegerType()


@pytest.fixture
def frame(spark):
    """A frame of rows with a schema of (name, type) pairs; the session is set up as the operators set it up."""
    from chronoweave.llm.text import ready

    ready(spark)
    return lambda rows, *fields: spark.createDataFrame(rows, T.StructType([T.StructField(name, kind) for name, kind in fields]))


@pytest.fixture
def documents(frame):
    """Documents from (id, text) pairs, with extra columns under names that operators might use themselves."""
    def make(*rows):
        return frame([(i, text, "en", None, "x", 7, "y") for i, text in rows], ("doc_id", LONG), ("text", TEXT), ("lang", TEXT), ("source", TEXT), ("node", TEXT), ("_id", INT), ("n_words", TEXT))

    return make


@pytest.fixture
def folder(documents, tmp_path):
    """A table folder with the given documents."""
    def make(*rows, **tables):
        path = str(tmp_path / f"tables{len(list(tmp_path.iterdir()))}")
        documents(*rows).write.parquet(f"{path}/documents.parquet")
        for name, held in tables.items():
            held.write.parquet(f"{path}/{name}.parquet")
        return path

    return make
