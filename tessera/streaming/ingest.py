"""Ingest: files of text arrive as a stream; each micro-batch is reconciled against a table of fingerprints."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import fingerprint

#: Kinds of file read as text, and how an authority is guessed from name and first words.
SUFFIXES = ("md", "markdown", "txt", "rst", "log", "csv", "json", "yaml", "yml")


def read_inbox(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, seen_at) of every new file below a folder, without hidden, lock and temporary ones."""
    raw = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    named = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("seen_at"))
    return named.where(~name.rlike(r"^(\.|~\$|__)") & F.lower(name).rlike(rf"\.({'|'.join(SUFFIXES)})$"))


def chunks(docs: DataFrame) -> DataFrame:
    """(path, n, chunk, fp): sections by heading or blank line, numbered, with their fingerprints."""
    parts = F.posexplode(F.split("text", r"\n\s*\n|\n(?=#)"))
    return docs.select("path", "seen_at", parts.alias("n", "chunk")).where("trim(chunk) <> ''").withColumn("fp", fingerprint(F.col("chunk")))


def reconcile(batch: DataFrame, table: str, number: int) -> DataFrame:
    """Chunks of batch `number` whose fingerprints no earlier batch holds, one of each. Its own rows, of a run that was cut off, do not count."""
    spark = batch.sparkSession
    new = batch.groupBy("fp").agg(F.min_by(F.struct(*batch.columns), F.struct("path", "n")).alias("x")).select("x.*")
    try:
        known = spark.read.parquet(table).where(F.col("batch") < number).select("fp")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return new
    return new.join(known, "fp", "left_anti")


def start(spark: SparkSession, inbox: str, table: str, checkpoint: str) -> StreamingQuery:
    """Adds new chunks to the table; one micro-batch is one reconciliation with the batches before it. A batch is written aside and then moved to its folder, so a
    repeated batch replaces its own and readers see whole ones only."""

    def each(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        aside, own = f"{table}/_aside/{number}", f"{table}/batch={number}"
        reconcile(batch, table, number).write.mode("overwrite").parquet(aside)
        path = s._jvm.org.apache.hadoop.fs.Path
        fs = path(table).getFileSystem(s._jsc.hadoopConfiguration())
        fs.delete(path(own), True)
        if not fs.rename(path(aside), path(own)):
            raise RuntimeError(f"could not move {aside}")

    return chunks(read_inbox(spark, inbox)).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
