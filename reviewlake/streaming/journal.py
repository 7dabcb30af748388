"""The journal as a stream: the same states as the batch fold, line by line."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reviewlake.operators.journal import FINAL, HUMAN_FULLTEXT, HUMAN_SCREEN, MACHINE_SCREEN, entries, known_entry
from reviewlake.sources.files import JOURNAL

STATE = "h_seq long, h string, m_seq long, m string, first_seq long"
OUTPUT = "identity_type string, doc string, decision string, resolved_by string, decided_seq long, first_seq long"


def read_journal_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """New journal files of a folder as they come."""
    return spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", files_per_batch).json(folder)


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    h_seq, h, m_seq, m, first = state.get if state.exists else (-1, None, -1, None, None)
    for pdf in batches:
        for seq, stage, decision in zip(pdf["seq"], pdf["stage"], pdf["decision"]):
            seq = int(seq)
            human = stage in HUMAN_SCREEN
            # Lines may come late or twice: only a later line of its kind replaces what is known.
            if human and seq > h_seq:
                h_seq, h = seq, decision
            elif not human and seq > m_seq:
                m_seq, m = seq, decision
            first = seq if first is None else min(first, seq)
    state.update((h_seq, h, m_seq, m, first))
    yield pd.DataFrame([(key[0], key[1], h if h is not None else m, "human" if h is not None else "machine", h_seq if h is not None else m_seq, first)], columns=["identity_type", "doc", "decision", "resolved_by", "decided_seq", "first_seq"])


def resolve_screening_stream(journal: DataFrame) -> DataFrame:
    """Updates of screening states: per document of a batch its state after the batch. A human decision outranks a machine one whatever the order."""
    lines = entries(journal).filter(F.col("stage").isin(*HUMAN_SCREEN, *MACHINE_SCREEN) & F.col("decision").isin(*FINAL)).select("identity_type", "doc", "seq", "stage", "decision")
    return lines.groupBy("identity_type", "doc").applyInPandasWithState(_fold, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def unknown_stream(journal: DataFrame) -> DataFrame:
    """Running counts of lines outside the vocabulary."""
    return journal.filter(~known_entry()).groupBy("stage", "decision").agg(F.count(F.lit(1)).alias("lines"))


CHANGE = "seq long, identity_type string, doc string, stage string, decision string"


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen, last = state.get if state.exists else (-1, None)
    rows = []
    for pdf in batches:
        rows += zip(pdf["seq"], pdf["decision"])
    out = []
    for seq, decision in sorted((int(a), b) for a, b in rows):
        # A line that came before is known, whatever it says.
        if seq > seen and decision != last:
            out.append((seq, *key, decision))
        if seq > seen:
            seen, last = seq, decision
    state.update((seen, last))
    yield pd.DataFrame(out, columns=["seq", "identity_type", "doc", "stage", "decision"])


def decision_changes(journal: DataFrame) -> DataFrame:
    """Human lines that change the decision of their document and stage; a line that repeats the last decision is a replay, at whatever time it comes."""
    lines = entries(journal).filter(F.col("stage").isin(*HUMAN_SCREEN, *HUMAN_FULLTEXT)).select("identity_type", "doc", "stage", "seq", "decision")
    return lines.groupBy("identity_type", "doc", "stage").applyInPandasWithState(_changes, CHANGE, "seen long, last string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(journal: DataFrame, width: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Lines per stage and window of event time; late lines count until the watermark passes."""
    timed = journal.withColumn("event_time", F.try_to_timestamp("ts")).withWatermark("event_time", lateness)
    return timed.groupBy(F.window("event_time", width), "stage").agg(F.count(F.lit(1)).alias("lines"))


def start(updates: DataFrame, path: str, checkpoint: str, name: str = "journal", mode: str = "update"):
    """Write updates as Parquet, a folder per batch; a batch that is tried again overwrites its folder, and the checkpoint resumes after an interruption."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return updates.writeStream.outputMode(mode).queryName(name).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
