"""Structured Streaming jobs: continuous inspection, repeats, lifecycle, deferred tier."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilscan.operators.alerts import alert_lines
from veilscan.operators.policies import version
from veilscan.plans.inspect import Corpus, inspect
from veilscan.session import ship_by_value
from veilscan.sources.rules import Rule, rules_from_table


ship_by_value(__name__)


def table_stream(spark: SparkSession, folder: str, file_glob: str, files_per_trigger: int = 64) -> DataFrame:
    """New parquet files of a folder as a stream, a bounded number of files per batch. What ``file_glob`` names
    may be files or, as a writer leaves a table, folders of files."""
    path = f"{folder}/{{{file_glob}}}"  # a pattern even for one name: a stream's plain path has to be a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


class RuleWatch:
    """Rules of a table, reloaded only when its version probe changes."""

    def __init__(self, read: Callable[[], DataFrame], updated: str = "updated_at") -> None:
        self.read, self.updated = read, updated
        self.seen, self.rules = None, []

    def current(self) -> list[Rule]:
        table = self.read()
        now = tuple(version(table, self.updated).first())
        if now != self.seen:
            self.seen, self.rules = now, rules_from_table(table)
        return self.rules


def start(batch: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = batch.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch to its own folder, so a repeated batch replaces its own output."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def inspection_feed(
    pages: DataFrame, with_policy: Callable[[DataFrame], DataFrame], rules: Callable[[], list[Rule]], out: str,
    checkpoint: str, corpus: Corpus | None = None, alert_host: str | None = None,
    shape: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Inspect arriving single-page documents with the batch pipeline; verdicts, evidence,
    pending pages and alert lines are written per batch. Rules are asked for once per batch,
    so a change is in force from the next batch on."""

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = shape(batch) if shape else batch
        result = inspect(with_policy(rows).select("job_id", "page", "text", "policy"), rules(), corpus, single_page=True)
        write_batch(result.verdicts, f"{out}/verdicts", batch_id)
        write_batch(result.evidence, f"{out}/evidence", batch_id)
        done = batch.sparkSession.read.parquet(f"{out}/verdicts/batch={batch_id}")
        write_batch(done.filter("scan_tier = 'ocr_pending'").select("job_id"), f"{out}/pending", batch_id)
        if alert_host is not None:
            stored = batch.sparkSession.read.parquet(f"{out}/evidence/batch={batch_id}")
            meta = rows.select("job_id", "username", "hostname", "queue", "title", "byte_size", "content_sha256",
                               "inline_ms", "created_at", "alert_at")
            lines = alert_lines(meta.join(done, "job_id"), stored, alert_host)
            lines.select("line").write.mode("overwrite").text(f"{out}/alerts/batch={batch_id}")

    return start(pages, step, checkpoint, available_now)


def first_submissions(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Repeats of a key within ``delay`` collapse to the first. The watermark bounds the state;
    a repeat that comes later than that counts as a new document."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


# What an event does to the state of a job; a decision needs a held job.
INSPECTED = {"allow": "released", "log": "released", "hold": "held", "block": "blocked"}
DECIDED = {"release": "released_by_analyst", "deny": "denied_by_analyst"}
PRINTED = ("released", "released_by_analyst", "failed_open", "released_then_flagged")


def next_state(state: str, kind: str) -> str:
    if kind in INSPECTED:
        return INSPECTED[kind]
    if kind in DECIDED:
        return DECIDED[kind] if state == "held" else state
    if kind == "flag":
        return "released_then_flagged" if state in PRINTED else "held"
    return state


#: All states a job can be in; a kind of event is a map over them, and maps chain to maps.
STATES = ("inspecting", "released", "held", "blocked", "released_by_analyst", "denied_by_analyst", "failed_open", "released_then_flagged")


def chained(kinds: Iterable[str]) -> tuple[int, ...]:
    """What a sequence of events does to each state, as places in ``STATES``."""
    now = list(STATES)
    for kind in kinds:
        now = [next_state(s, kind) for s in now]
    return tuple(STATES.index(s) for s in now)


def lifecycle_states(events: DataFrame, delay: str = "1 hour", idle_ms: int = 30 * 24 * 3600 * 1000) -> DataFrame:
    """State per job over a stream of ``(job_id, at timestamp, event_id, kind)``: a row per job and batch,
    with the events counted so far and the latest time applied.

    Events may come in any order within ``delay``. They wait in the job's state until the watermark has
    passed them and are then applied in the order of (at, event_id), so the result does not depend on how
    the stream is cut into batches. Once all of a job's events are applied its state is one word, a counter
    and a time, dropped after ``idle_ms`` without events; an event that comes back later than that finds a
    row it has already written and counts anew. Before the watermark moves at the end of a finished stream
    the events still waiting are shown as if applied (``settled`` is false): the last row is the state by
    all events seen.
    """

    def advance(key: tuple, parts: Iterable, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut and not json.loads(state.get[2]):
            state.remove()
            return
        word, seen, waiting, last = state.get if state.exists else ("inspecting", 0, "[]", 0)
        rows = json.loads(waiting)
        if not state.hasTimedOut:
            for part in parts:
                rows += [[int(at.value // 1000), int(n), kind] for at, n, kind in zip(part["at"], part["event_id"], part["kind"])]
        rows.sort()
        mark = state.getCurrentWatermarkMs()
        ripe = [r for r in rows if r[0] // 1000 < mark]
        rows = rows[len(ripe):]
        if ripe:
            word, seen, last = STATES[chained(r[2] for r in ripe)[STATES.index(word)]], seen + len(ripe), max(last, ripe[-1][0])
        state.update((word, seen, json.dumps(rows), last))
        state.setTimeoutTimestamp(max(mark + 1, (rows[0][0] // 1000 + 1) if rows else last // 1000 + idle_ms))
        shown = STATES[chained(r[2] for r in rows)[STATES.index(word)]]
        yield pd.DataFrame({"job_id": [key[0]], "state": [shown], "events": [seen + len(rows)], "settled": [not rows]})

    return events.withWatermark("at", delay).groupBy("job_id").applyInPandasWithState(
        advance, "job_id bigint, state string, events bigint, settled boolean", "state string, events bigint, waiting string, last bigint",
        "update", GroupStateTimeout.EventTimeTimeout,
    )


def latest_states(updates: DataFrame) -> DataFrame:
    """Final state per job out of the update rows a lifecycle stream has written."""
    return updates.groupBy("job_id").agg(F.max_by("state", F.struct("events", "settled")).alias("state"), F.max("events").alias("events"))


def deferred_feed(
    pending: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Second query over the sink of pending jobs; ``step`` maps pending job ids to their
    outcomes."""
    return start(pending, lambda batch, n: write_batch(step(batch), out, n), checkpoint, available_now)


#: Keys that timers are dealt to by their job's hash. A call per job would cost a batch of small frames each.
TIMER_KEYS = 1 << 15


def purges_due(jobs: DataFrame, clock: DataFrame, delay: str = "0 seconds", keys: int = TIMER_KEYS) -> DataFrame:
    """Ids of ``jobs(job_id, purge_after timestamp, purged)`` whose deadline the watermark of ``clock(at
    timestamp)`` has passed, each once, as a stream of (job_id, purge_after).

    A job's deadline is a timer in the state of the job's key, 16 bytes each; the key wakes at its earliest
    one. A batch reads the jobs that arrive in it and the timers of their keys, and a job leaves the state when
    its timer fires. Clock rows carry no job. A job that was purged before has no timer.
    """

    def wait(key: tuple, parts: Iterable, state: GroupState) -> Iterator:
        import numpy as np
        import pandas as pd

        held = np.frombuffer(bytes(state.get[0]) if state.exists else b"", np.int64).reshape(-1, 2)  # id, due
        if not state.hasTimedOut:
            found = [held]
            for part in parts:
                rows = part[part["due"].notna()]
                ids = rows["job_id"].to_numpy(np.int64) if key[0] >= 0 else np.zeros(len(rows), np.int64)
                found.append(np.column_stack([ids, rows["due"].to_numpy("datetime64[us]").astype(np.int64)]))
            held = np.concatenate(found)
            held = held[np.lexsort((held[:, 1], held[:, 0]))]
            held = held[np.diff(held[:, 0], prepend=held[:1, 0] - 1) != 0]  # a job's earliest
        mark = state.getCurrentWatermarkMs()
        ripe = held[:, 1] // 1000 < mark
        gone, held = held[ripe], held[~ripe]
        if len(held):
            state.update((held.tobytes(),))
            state.setTimeoutTimestamp(max(int(held[:, 1].min()) // 1000, mark + 1))
        elif state.exists:
            state.remove()
        if len(gone):
            ids = pd.Series(gone[:, 0], dtype="Int64")
            yield pd.DataFrame({"job_id": ids if key[0] >= 0 else ids.mask(ids == 0), "purge_after": gone[:, 1].astype("datetime64[us]").astype("datetime64[ns]")})

    ticks = clock.select("at", F.lit(None).cast("bigint").alias("job_id"), F.lit(None).cast("timestamp").alias("due"))
    # Without a time of their own, jobs neither move the watermark nor come too late for it.
    timers = jobs.filter("not purged").select(F.lit(None).cast("timestamp").alias("at"), "job_id", F.col("purge_after").alias("due"))
    both = ticks.union(timers).withWatermark("at", delay)
    # Ticks and jobs without an id have keys of their own, so that ids stay whole numbers in pandas.
    dealt = F.when(F.col("due").isNull(), -1).when(F.col("job_id").isNull(), -2).otherwise(F.pmod(F.xxhash64("job_id"), F.lit(keys)))
    return both.withColumn("key", dealt).groupBy("key").applyInPandasWithState(
        wait, "job_id bigint, purge_after timestamp", "timers binary", "append", GroupStateTimeout.EventTimeTimeout,
    )
