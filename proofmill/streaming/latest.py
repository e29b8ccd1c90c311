"""The latest record of each subject and type, kept up to date as records come in.

The rank is the ledger's: the newest time first, of one time the larger id. State is one record a key. A new record
that goes before the one that is held takes its place, and the old one is retracted; all others change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "subject_id string, detection_type string, id string, created_at timestamp, change int"


class _Latest(StatefulProcessor):
    """One ValueState a key: the record that comes first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "created_at timestamp, id string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self.held.get() if self.held.exists() else None
        best = old and (old[0], old[1])
        for batch in rows:
            for created, ident in zip(batch["created_at"], batch["id"], strict=True):
                new = (None if pd.isna(created) else pd.Timestamp(created).to_pydatetime(), ident)
                if best is None or _before(new, best):
                    best = new
        changes = []
        if best and (old is None or best != (old[0], old[1])):
            if old is not None:
                changes.append((old[0], old[1], -1))
            changes.append((*best, 1))
            self.held.update(best)
        frame = pd.DataFrame(changes, columns=["created_at", "id", "change"])
        frame.insert(0, "detection_type", key[1])
        frame.insert(0, "subject_id", key[0])
        yield frame[["subject_id", "detection_type", "id", "created_at", "change"]].astype({"change": "int32"})

    def close(self) -> None:
        pass


def _before(new: tuple, old: tuple) -> bool:
    """Times downwards, null last; of one time the larger id."""
    if (new[0] is None) != (old[0] is None):
        return new[0] is not None
    return (new[0] or 0, new[1] or "") > (old[0] or 0, old[1] or "")


def latest_changes(facts: DataFrame) -> DataFrame:
    """(subject_id, detection_type, id, created_at, change) of a stream of (subject_id, detection_type, id, created_at): 1
    for a record that has become the latest, -1 for the one that it takes the place of."""
    rows = facts.select("subject_id", "detection_type", "id", F.col("created_at").cast("timestamp").alias("created_at"))
    return rows.groupBy("subject_id", "detection_type").transformWithStateInPandas(statefulProcessor=_Latest(), outputStructType=OUT, outputMode="Update", timeMode="None")


def settled(changes: DataFrame) -> DataFrame:
    """What is the latest once all changes are added up."""
    keys = ["subject_id", "detection_type", "id", "created_at"]
    return changes.groupBy(*keys).agg(F.sum("change").alias("n")).where("n > 0").select(*keys)


