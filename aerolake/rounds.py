"""Tables between the rounds of an iteration: written to the shared checkpoint folder, so that lineage stays short and a lost executor costs a read."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that may be broadcast; beyond them its joins shuffle.
MOST_BROADCAST = 32 << 20


def _folder(spark: SparkSession) -> None:
    """Set a checkpoint folder where there is none: a temporary one under a local master, else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="rounds-")
    sc.setCheckpointDir(base)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read again from the shared folder."""
    _folder(df.sparkSession)
    return df.checkpoint()


def width(df: DataFrame) -> Column:
    """About the bytes of a row in memory."""
    sized = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    sized += [F.greatest(F.size(f"`{f.name}`"), F.lit(0)) * 16 for f in df.schema.fields if f.dataType.typeName() == "array"]
    return sum(sized, F.lit(24 + 16 * len(df.columns))).cast("long")


def small(df: DataFrame) -> DataFrame:
    """A cut table, marked for broadcast if its bytes, which are counted, are few."""
    held = df.agg(F.coalesce(F.sum(width(df)), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= MOST_BROADCAST else df
