"""Cutting lineage where iteration needs it."""

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, in the folder of spark.checkpoint.dir; where that is unset, in a temporary one, on a local master only."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()


#: Bytes, as Spark's planner expects them, that go to one part.
PART = 2 << 20


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by the hash of keys, in as many parts as a shuffle has, or more where its expected bytes ask for it. Spark makes the parts of its own shuffles larger
    as tables grow, up to so many compressed bytes; a count that is given holds, so what one task keeps does not grow with the table. Rows that come from no
    file have no expected size, and joins too large a one."""
    spark = df.sparkSession
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    more = min(-(-expected // PART), 10_000) if expected < 1 << 50 else 1
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), more), *keys)
