"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract in this subpackage: space and \t \n \v \f \r.
WS = " \t\n\x0b\x0c\r"
WS_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the maximal runs of characters that aren't white space; null text: no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS_RE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only where none is set and all tasks run in this machine's own process (tests)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: tasks on other machines need a shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="stratacat-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the shared folder: survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def gathered(df: DataFrame) -> DataFrame:
    """df, a table that is cut, in no more partitions than run at once (16 at least): for one pass over it that keeps no more than sums."""
    return df.coalesce(max(16, df.sparkSession.sparkContext.defaultParallelism))


def sized(df: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """df cut, and marked for broadcast only if its rows, counted and measured as text, have no more than most_bytes; else Spark joins it as it would any table. What is marked comes in a partition for each 256 KB begun, however many all but empty ones it was cut in."""
    df = cut(df)
    if not df.columns:
        return df
    n = gathered(df).agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))), F.lit(0))).first()[0]
    return F.broadcast(df.coalesce(1 + n // (256 << 10))) if n <= most_bytes else df


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """fn on the columns of each Arrow batch, as lists. A batch holds no more than spark.sql.execution.arrow.maxRecordsPerBatch rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                yield pa.RecordBatch.from_pydict(fn(part.to_pydict()), schema=out)

    return df.mapInArrow(run, schema)
