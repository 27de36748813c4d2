"""Annotation saves as a stream: revisions are appended, the current state follows in versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.annotate import ENTITY, RELATION, current_annotations, revisions_of

EVENT = f"sentence_id string, saved_at timestamp, status string, entities array<{ENTITY}>, relations array<{RELATION}>"
#: Versions of the current state that stay, so that a reader of the last one isn't cut off.
KEPT = 3


def _versions(spark: SparkSession, current: str) -> tuple:
    """The file system of a state's folder, and its complete versions in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(current)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{current}/version=*/_SUCCESS")) or []
    return fs, sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in found)


def current_state(spark: SparkSession, current: str, below: int | None = None) -> DataFrame | None:
    """The latest complete version of the current state, or the latest below a number; None where there is none."""
    known = [v for v in _versions(spark, current)[1] if below is None or v < below]
    return spark.read.parquet(f"{current}/version={known[-1]}") if known else None


def annotation_stream(spark: SparkSession, inbox: str, revisions: str, current: str, checkpoint: str) -> StreamingQuery:
    """Reads save events as JSON from ``inbox``; every batch appends its revisions and writes the next current state.

    A batch reads the state before it, which holds each sentence's last revision, never the whole log. Its
    revisions land in a folder and its state in a version named by its number, so a batch run twice
    replaces itself, and readers keep the version they have.
    """
    events = spark.readStream.schema(EVENT).json(inbox)

    def apply(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        own = f"{revisions}/batch={number}"
        before = current_state(session, current, number)
        revisions_of(batch, before).write.mode("overwrite").parquet(own)
        state = current_annotations(session.read.parquet(own))
        if before is not None:
            state = before.join(state.select("sentence_id"), "sentence_id", "left_anti").select(*state.columns).unionByName(state)
        state.write.mode("overwrite").parquet(f"{current}/version={number}")
        fs, versions = _versions(session, current)
        for old in versions[:-KEPT]:
            fs.delete(session._jvm.org.apache.hadoop.fs.Path(f"{current}/version={old}"), True)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
