"""Streams: run totals over an append-only log, and per-case conversation state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.consumer import INTAKE_TERMS, WISHES
from ..operators.records import run_totals
from ..sources.readers import RUN


def log_totals(spark: SparkSession, path: str) -> DataFrame:
    """Running totals of the runs logged under ``path``."""
    return run_totals(spark.readStream.schema(RUN).json(path))


def unique_messages(messages: DataFrame, *, delay: str = "1 hour", at: str = "created_at") -> DataFrame:
    """Each client message once within the watermark, however often it is sent."""
    return messages.withWatermark(at, delay).dropDuplicatesWithinWatermark(["case_id", "client_message_id"])


STATE = "complaint string, category string, wish string, messages long"
OUTPUT = "case_id string, complaint_summary string, issue_category string, desired_resolution string, messages long"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """First complaint, category and wish of a case; state ends when the case is idle too long."""
    if state.hasTimedOut:
        state.remove()
        return
    complaint, category, wish, n = state.get if state.exists else (None, None, None, 0)
    for batch in batches:
        for text in batch.sort_values(["created_at", "client_message_id"])["content"]:
            clean = " ".join((text or "").split())
            low = clean.casefold()
            n += 1
            complaint = clean if complaint is None else complaint
            category = category or next((c for c, terms in INTAKE_TERMS if any(t in low for t in terms)), "other")
            wish = clean if wish is None and any(w in low for w in WISHES) else wish
    state.update((complaint, category, wish, n))
    state.setTimeoutDuration(24 * 3600 * 1000)
    yield pd.DataFrame([(key[0], complaint, category, wish, n)], columns=["case_id", "complaint_summary", "issue_category", "desired_resolution", "messages"])


def case_facts(messages: DataFrame) -> DataFrame:
    """The facts of each case after each batch of messages (case_id, client_message_id, content, created_at)."""
    return messages.groupBy("case_id").applyInPandasWithState(_step, OUTPUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def put_batch(rows: DataFrame, path: str, batch: int) -> None:
    """One batch as one partition of a table, so a batch that is tried again replaces itself."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def stage_progress(stages: DataFrame, path: str, checkpoint: str):
    """Put each batch of stage rows in a progress table; its column ``batch`` is the number of the batch."""
    return stages.writeStream.foreachBatch(lambda rows, batch: put_batch(rows, path, batch)).option("checkpointLocation", checkpoint).start()
