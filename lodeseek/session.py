"""Sessions, the package's own code on executors, and the folder that all of them share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors of the session, once: their Python workers import it by name."""
    context = spark.sparkContext
    if getattr(context, "_lodeseek_shipped", False):
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="lodeseek-")) / "lodeseek.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    context.addPyFile(str(at))
    context._lodeseek_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where all executors are this process, a folder of our own may stand in for it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lodeseek-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder; Spark's cleaner removes it once nothing refers to it."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df, computed once and written as Parquet below the shared folder, for large tables: readers take the columns that they need. It stays for the cluster's clean-up of that folder."""
    at = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def session(name: str = "lodeseek", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings that the engine expects: adaptive plans, UTC and Arrow."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    wanted = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (wanted | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
