"""Session plumbing shared by all operators: table loading, checkpoints and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that Python workers import it and keep module caches."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="tracemill"), "tracemill.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in (".py", ".json"):
                z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def spread(df: DataFrame) -> DataFrame:
    """More partitions for inputs with fewer than the cluster has cores; larger inputs stay as they are read, unshuffled. Python follows, so
    the package is sent."""
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage in the shared folder of ``spark.checkpoint.dir``. Only in local mode, as in tests, one is made where none is set: on
    a cluster a folder of this machine is none that the executors could read, so that is an error."""
    ship(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tracemill-ckpt"))
    return df.checkpoint(eager=eager)


#: Rows of a lookup table that are broadcast; with more, both sides are shuffled.
MOST_SENT, SALTS = 200_000, 32


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], most: int = MOST_SENT, how: str = "inner") -> DataFrame:
    """Join (inner or left) of many rows with a checkpointed table of one row a key; null keys meet null keys.

    The table is counted. Up to ``most`` rows it is broadcast, so the rows stay where they are; beyond, they are shuffled with a salt and
    the table is repeated for each, so that a key that a third of the rows bear goes to many tasks.
    """
    key = lambda df: F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in on), *(F.col(c).isNull().alias(f"_{c}") for c in on))
    if table.count() <= most:
        t = table.select(key(table).alias("_key"), *(c for c in table.columns if c not in on))
        return rows.withColumn("_key", key(rows)).join(F.broadcast(t), "_key", how).drop("_key")
    t = table.select(key(table).alias("_key"), *(c for c in table.columns if c not in on), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = rows.withColumn("_key", key(rows)).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.join(t, ["_key", "_salt"], how).drop("_key", "_salt")
