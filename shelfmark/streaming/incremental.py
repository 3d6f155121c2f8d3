"""Check newly arrived files against the catalogues without looking at the old ones again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.reconcile import SCOPE, wanted_hashes

FILE = ["collection", "file_name", "member_name"]


LOG = "collection string, file_name string, member_name string, hash string, batch_id bigint"


def refresh_wanted(entries: DataFrame, path: str) -> None:
    """Write what catalogues want: those in ``entries`` are replaced as a whole, others stay. May be called at any time.

    Files that came before are matched as well, since matching happens on read.
    """
    wanted_hashes(entries).write.partitionBy(*SCOPE).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/wanted")


def start(arrivals: DataFrame, entries: DataFrame, path: str, checkpoint: str, **trigger):
    """``arrivals``: stream of collection, file_name, member_name, hash.

    The wanted hashes of ``entries`` are written when the stream starts (see ``refresh_wanted`` for later changes). Each
    batch appends its files under its batch id, so it costs its own size; no state is kept. What a file holds is settled
    on read: the last batch that delivered it counts.
    """
    refresh_wanted(entries, path)

    def write(batch: DataFrame, batch_id: int) -> None:
        # a file that comes twice in one batch has no order there: the larger hash stands
        files = batch.groupBy(*FILE).agg(F.max(F.lower("hash")).alias("hash"))
        files.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.partitionBy("batch_id").mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").parquet(f"{path}/log")

    return (
        arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def _log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all batches; none when nothing has arrived yet."""
    try:
        return spark.read.schema(LOG).parquet(f"{path}/log")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def _base(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """Rows of the last compaction and the batch it goes up to."""
    try:
        bases = spark.read.schema(LOG + ", upto bigint").parquet(f"{path}/base")
    except AnalysisException:  # nothing has been compacted yet
        return None, -1
    upto = bases.agg(F.max("upto")).first()[0]
    return (None, -1) if upto is None else (bases.where(F.col("upto") == upto).drop("upto"), upto)


def holdings(spark: SparkSession, path: str) -> DataFrame:
    """What each file held last: FILE, hash, batch_id. Reads the last compaction and the batches after it."""
    base, upto = _base(spark, path)
    log = _log(spark, path).where(F.col("batch_id") > upto)
    rows = log if base is None else base.unionByName(log)
    return rows.groupBy(*FILE).agg(F.max_by("hash", "batch_id").alias("hash"), F.max("batch_id").alias("batch_id"))


def compact(spark: SparkSession, path: str) -> int:
    """Fold all batches so far into one row a file, beside the log; returns the last batch folded.

    A repeated compaction writes the same rows again, and batches that arrive meanwhile stay in the log.
    """
    upto = _log(spark, path).agg(F.max("batch_id")).first()[0]
    if upto is not None:
        folded = holdings(spark, path).where(F.col("batch_id") <= upto).withColumn("upto", F.lit(upto).cast("bigint"))
        folded.write.partitionBy("upto").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/base")
    return -1 if upto is None else upto


def found(spark: SparkSession, path: str) -> DataFrame:
    """First source and number of files per wanted hash, by what each file held last and what is wanted now."""
    return (
        holdings(spark, path).join(spark.read.schema("hash string, collection string, catalog string").parquet(f"{path}/wanted"), ["collection", "hash"])
        .groupBy(*SCOPE, "hash")
        .agg(F.min(F.struct("file_name", "member_name")).alias("s"), F.count(F.lit(1)).alias("n_copies"))
        .select(*SCOPE, "hash", "s.*", "n_copies")
    )
