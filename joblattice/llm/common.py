"""What the operators share: reading tables, scratch folders, words."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblattice.session import shared_dir

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of its own in the folder that all executors share."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a small intermediate table to the shared folder and reads it back.

    Its lineage ends there, so a lost executor costs a read, and its size is
    known to the planner before the next join.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to a Python worker at once; a batch of whole texts has no bound by rows alone.
BATCH_BYTES = 4 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """The rows, of which no more than about BATCH_BYTES lie in a batch for Python."""
    spark = df.sparkSession
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def release() -> None:
    """Memory that a task is done with goes back; a worker lives on and would hold it beside the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def whole_text(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has, without keeping them."""
    parts = F.split(text, SPACES)
    return (F.size(parts) - F.size(F.filter(parts, lambda w: w == ""))).cast("long")
