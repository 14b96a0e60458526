"""Where operators and queries keep tables of their own: the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder; a new local one only where none is set and the session is local, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}"


@contextmanager
def few_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Tables written meanwhile hand Python ``n`` rows at a time at most, not the session's number: for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialise(df: DataFrame, block: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: what depends on how rows were dealt stays as it was.

    Rows that are large are written in parts of about ``block`` bytes, as a part is read whole.
    """
    path = scratch_path(df.sparkSession, f"table-{uuid.uuid4().hex}")
    out = df.write.option("compression", "zstd")
    if block:  # the writer looks at a part's size after 100 rows otherwise
        out = out.option("parquet.block.size", str(block)).option("parquet.page.size.row.check.min", "4")
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
