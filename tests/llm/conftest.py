import pyarrow as pa
import pytest
from hypothesis import settings
from pyspark.sql import functions as F

settings.register_profile("shared", deadline=None)  # the machine is shared
settings.load_profile("shared")

EXTRA = ["__gone", "__id", "__drop", "h", "h1", "rep", "key", "n", "at", "a.b", "n_tokens", "count"]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, or (doc_id, text) pairs; wide: with columns whose names operators might use themselves."""

    def documents(rows, wide=False):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for c in EXTRA if wide else ():
            df = df.withColumn(c, F.lit("x"))
        return df

    return documents


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


class Wide:
    """A table whose chunks can't become one, as Arrow leaves those of more than 2 GiB of text."""

    def __init__(self, *batches):
        self.table = pa.Table.from_batches(batches)

    def combine_chunks(self):
        return self.table

    def __getattr__(self, name):
        return getattr(self.table, name)


def thue_morse(letters):
    """A text of two letters and its complement: polynomial hashes modulo a power of two can't tell them apart."""
    one = "a"
    while len(one) < letters:
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))
