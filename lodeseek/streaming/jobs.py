"""The job queue as a file stream. [N1-N6]

Submitting drops a JSON file into the queue folder. The worker is a Structured Streaming query over that folder: each
micro-batch runs its jobs in the order of their creation and appends their states to the state table, so a restart
goes on where the checkpoint stands and no two workers take one job. The latest state of a job is the row with the
greatest update time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES, STATES = ("ingest", "chunk", "index", "pipeline"), ("pending", "running", "completed", "failed")
JOB = "job_id string, type string, created_at string, params string"
STATE = "job_id string, type string, status string, created_at string, updated_at string, params string, result string, error string, seq long"


def now() -> str:
    return f"{datetime.now(UTC):%Y%m%d_%H%M%S_%f}"


class Queue:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _write(self, path: str, text: str) -> None:
        """A file that appears whole: it is renamed into place."""
        jvm = self.spark.sparkContext._jvm
        to, draft = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}"))
        fs = to.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        fs.rename(draft, to)

    def submit(self, kind: str, params: dict) -> str:
        if kind not in TYPES:
            raise ValueError(f"Unknown job type: {kind}")
        at = now()
        job = f"{kind}_{at}_{uuid.uuid4().hex[:4]}"
        self._write(f"{self.root}/queue/{job}.json", json.dumps({"job_id": job, "type": kind, "created_at": at, "params": json.dumps(params)}))
        return job

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def start(self, handler: Callable[[str, dict], dict], interval: float | None = None):
        """Runs the queue: what is there now, or for good with an interval in seconds. A failing job fails alone."""
        self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/queue").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/queue"))
        root = self.root

        def batch(df: DataFrame, epoch: int) -> None:
            rows, seq = [], 0
            for r in df.orderBy("created_at", "job_id").collect():  # a batch has at most maxFilesPerTrigger jobs
                begun = {"job_id": r["job_id"], "type": r["type"], "created_at": r["created_at"], "params": r["params"], "result": None, "error": None}
                rows.append({**begun, "status": "running", "updated_at": now(), "seq": (seq := seq + 1)})
                try:
                    done = {"status": "completed", "result": json.dumps(handler(r["type"], json.loads(r["params"] or "{}")), default=str)}
                except Exception as e:  # noqa: BLE001 any job may fail in any way
                    done = {"status": "failed", "error": str(e)}
                rows.append({**begun, **done, "updated_at": now(), "seq": (seq := seq + 1)})
            if rows:
                # a batch that runs again after a crash writes the same folder again
                df.sparkSession.createDataFrame([tuple(r[c.split()[0]] for c in STATE.split(", ")) for r in rows], STATE).coalesce(1).write.mode("overwrite").parquet(f"{root}/states/epoch={epoch}")

        stream = self.spark.readStream.schema(JOB).option("maxFilesPerTrigger", 16).json(f"{self.root}/queue")
        writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.root}/checkpoint")
        return (writer.trigger(processingTime=f"{interval} seconds") if interval else writer.trigger(availableNow=True)).start()

    def states(self) -> DataFrame:
        """The latest state of every job, pending ones included. [N6]"""
        none = self.spark.createDataFrame([], STATE)
        queued = self.spark.read.schema(JOB).json(f"{self.root}/queue") if self._exists(f"{self.root}/queue") else self.spark.createDataFrame([], JOB)
        pending = queued.select("job_id", "type", F.lit("pending").alias("status"), "created_at", F.col("created_at").alias("updated_at"), "params", F.lit(None).cast("string").alias("result"), F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("seq"))
        past = self.spark.read.schema(STATE).parquet(f"{self.root}/states").select(*[c.split()[0] for c in STATE.split(", ")]) if self._exists(f"{self.root}/states") else none
        return latest(pending.unionByName(past))

    def jobs(self, status: str | None = None, limit: int = 50) -> DataFrame:
        """Newest first; the limit counts jobs of the asked state."""
        if status is not None and status not in STATES:
            raise ValueError(f"Unknown job status: {status}")
        rows = self.states()
        rows = rows.where(F.col("status") == status) if status else rows
        return rows.orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)


def latest(states: DataFrame) -> DataFrame:
    """The last state of each job: one aggregation. [N3]"""
    columns = [c for c in states.columns if c != "job_id"]
    return states.groupBy("job_id").agg(F.max_by(F.struct(*columns), F.struct("updated_at", "seq")).alias("s")).select("job_id", "s.*")
