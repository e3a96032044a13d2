"""Conversations about cases as a keyed stream with state: facts, confirmation, repeated messages, idle cases.

What a message says is found by native expressions before the state is asked, so the
stateful part only keeps first values.  Each event is a message or a confirmation:

* a message fills the facts that are still open, and takes back an earlier confirmation,
  since what is new needs a new look;
* a confirmation counts if no fact is missing;
* an event whose client id was seen before changes nothing and is answered as before;
* a case that is idle for ``idle`` milliseconds is forgotten, by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import any_term, collapse
from ..operators.consumer import INTAKE_TERMS, PERIOD, WISHES, first_category, missing, next_question, supplier

#: Provider of the state that ``conversations`` needs: set it in ``spark.sql.streaming.stateStore.providerClass``.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 24 * 3600 * 1000
FIELDS = ["bank_name", "issue_category", "complaint_summary", "incident_date_or_period", "desired_resolution"]
FACTS = ", ".join(f"{f} string" for f in FIELDS) + ", messages long, confirmed boolean"
OUTPUT = f"case_id string, client_message_id string, {FACTS}, repeated boolean"


def said(events: DataFrame) -> DataFrame:
    """Events (case_id, client_message_id, kind, content, created_at) with what each message states."""
    clean = collapse(F.coalesce("content", F.lit("")))
    low = F.lower(clean)
    stated = {
        "bank_name": supplier(F.col("content")),
        "issue_category": first_category(low, INTAKE_TERMS, F.lit("other")),
        "complaint_summary": F.nullif(clean, F.lit("")),
        "incident_date_or_period": F.nullif(F.regexp_extract(clean, PERIOD, 0), F.lit("")),
        "desired_resolution": F.when(any_term(low, WISHES), clean),
    }
    return events.select("case_id", "client_message_id", "kind", F.col("created_at").cast("timestamp").alias("created_at"), *[F.when(F.col("kind") == "message", c).alias(n) for n, c in stated.items()])


class Conversation(StatefulProcessor):
    """State of a case: its facts, and the client ids of its events for as long as ``idle``."""

    def __init__(self, idle: int = DAY):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", FACTS)
        self.seen = handle.getMapState("seen", "id string", "n long", self.idle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        stored = self.facts.get() if self.facts.exists() else None
        facts = dict(zip([*FIELDS, "messages", "confirmed"], stored or (*[None] * len(FIELDS), 0, False), strict=True))
        out = []
        events = pd.concat(list(rows)).sort_values(["created_at", "client_message_id"])
        for event in events.to_dict("records"):
            name = event["client_message_id"]
            repeated = bool(name) and self.seen.containsKey((name,))
            if not repeated:
                self._take(facts, event)
                if name:
                    self.seen.updateValue((name,), (facts["messages"],))
            out.append((key[0], name, *facts.values(), repeated))
        self.facts.update(tuple(facts.values()))
        for timer in list(self.handle.listTimers()):  # a pending iteration would hold the state server
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield pd.DataFrame(out, columns=["case_id", "client_message_id", *facts, "repeated"])

    def _take(self, facts: dict[str, Any], event: dict[str, Any]) -> None:
        if event["kind"] == "message":
            for field in FIELDS:
                if facts[field] is None and isinstance(event[field], str):
                    facts[field] = event[field]
            facts["messages"] += 1
            facts["confirmed"] = False
        elif event["kind"] == "confirmation":
            facts["confirmed"] = all(facts[f] is not None for f in FIELDS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.facts.clear()
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def conversations(events: DataFrame, *, idle: int = DAY) -> DataFrame:
    """The state of each case after each event, the missing facts and the next question."""
    rows = said(events).groupBy("case_id").transformWithStateInPandas(statefulProcessor=Conversation(idle), outputStructType=OUTPUT, outputMode="Update", timeMode="ProcessingTime")
    lacking = missing(FIELDS)
    return rows.withColumn("missing", lacking).withColumn("question", next_question(lacking, F.lit(False)))
