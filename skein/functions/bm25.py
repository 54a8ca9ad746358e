"""BM25 as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1 = 1.2
B = 0.75


def bm25(tf: Column | float, doclen: Column | float, avgdl: Column, df: Column, n: Column) -> Column:
    """Score of one term in one document; 0 where the term or the segment is empty.

    An avgdl of 0 makes the length part infinite and the score 0, instead of an error.
    """
    tf = tf if isinstance(tf, Column) else F.lit(float(tf))
    doclen = (doclen if isinstance(doclen, Column) else F.lit(float(doclen))).cast("double")
    df, n = df.cast("double"), n.cast("double")
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    norm = tf * (K1 + 1) / (tf + K1 * (1 - B + B * doclen / F.nullif(avgdl, F.lit(0.0))))
    return F.when((df == 0) | (n == 0), F.lit(0.0)).otherwise(idf * F.coalesce(norm, F.lit(0.0)))


def average_length(total: Column, count: Column) -> Column:
    """Average document length in single precision, as it is stored; 0 without documents."""
    one = lambda c: c.cast("float").cast("double")
    return F.coalesce((one(total) / F.nullif(one(count), F.lit(0.0))).cast("float").cast("double"), F.lit(0.0))
