"""Session settings and the shared scratch folder."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even when that costs one more exchange afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # broadcast what was measured in a shuffle, nothing by estimate: estimates don't see rows multiply, nor names unpack
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "1m",
    # many small files to a task; tables still go to every core
    "spark.sql.files.openCostInBytes": "256k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to an existing session."""
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark


def build(app: str = "shelfmark", master: str | None = None, partitions: int | None = None,
          memory: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in {**ADAPTIVE, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: bytes of an Arrow batch for Python, where the session sets none: rows of any length come in batches of bounded size
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once a Spark context (later changes to its files are not sent), and bound Arrow batches."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH[0], None) is None:
        spark.conf.set(*BATCH)
    if getattr(sc, "_shelfmark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    # put down in the shared folder, through Spark's own file systems
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark, 'code')}/shelfmark.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(raw.getvalue()))
    out.close()
    sc.addPyFile(path.toString())
    sc._shelfmark_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        wanted = tempfile.mkdtemp(prefix="shelfmark-")
    sc.setCheckpointDir(wanted)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder for an intermediate table."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    A lost executor then does not replay what came before, and several joins read the same rows.
    """
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Shuffle by ``columns`` into the configured number of partitions, before rows multiply.

    Adaptive execution merges partitions by their size on arrival; a given number keeps them apart
    so that an explode behind it stays spread out.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
