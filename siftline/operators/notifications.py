"""Notification gates with memory, and the digest of what was not told (SCO-20, SCO-21, STR-5, STR-9, FLT-6, FLT-18).

Gates that look at one event alone are columns, in their order.  Memory is a state for each
(user, job): the score last told.  It is a fold over the events in order of time, written
once (``remember``) and run on a table, sorted within partitions and streamed, or on a stream
with ``transformWithState``; both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

L = F.lit
# Least score, days a posting may be old (twice as many for evergreen and hiring companies), days and postings that mean hiring, points by which a score must rise to be told again.
LEAST_SCORE, MOST_AGE, RECENT_DAYS, HIRING, RISE = 70, 30, 14, 3, 5
BOARD_COPY = "remoteok-"
HOLDS = ("BELOW_SCORE", "OUTSIDE_COUNTRIES", "TOO_OLD", "BOARD_COPY", "ALREADY_NOTIFIED", "NOT_APPLY", "ACTED_ON")
DECIDED = "user_id long, job_id long, event_id long, ts timestamp, score double, hold_reason string, last_told double"


def recent_postings(events: DataFrame, jobs: DataFrame, days: int = RECENT_DAYS) -> DataFrame:
    """``events`` (with company_id, ts) and ``recent``: postings of the company first seen in the days up to the event.

    Events and postings are stacked and swept twice in order of time, up to the event and up to
    the days before it, each time with one running sum; so there is no range join, and no frame
    that is summed anew for each event.
    """
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    asked = events.select("company_id", F.struct(*events.columns).alias("__row"), at("ts").alias("__at"), (at("ts") - days * 86_400_000_000).alias("__from"), L(1).alias("__side"), L(0).cast("long").alias("__n"))
    none = L(None).cast(asked.schema["__row"].dataType)
    seen = jobs.where("company_id is not null and first_seen is not null").groupBy("company_id", at("first_seen").alias("__at")).agg(F.count(L(1)).alias("__n"))
    stacked = asked.unionByName(seen.select("company_id", none.alias("__row"), "__at", F.col("__at").alias("__from"), L(0).alias("__side"), "__n"))
    # postings at the event's time count, those at the first moment of the days too
    so_far = lambda *order: F.sum("__n").over(Window.partitionBy("company_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    swept = stacked.withColumn("__upto", so_far("__at", "__side")).withColumn("__before", so_far("__from", F.desc("__side")))
    return swept.where("__side = 1").select("__row.*", (F.col("__upto") - F.col("__before")).alias("recent"))


def recent_decides(score: Column, in_countries: Column, age_days: Column, evergreen: Column) -> Column:
    """Whether ``gates_before_memory`` depends on how many postings are recent; never null."""
    return F.coalesce((score >= LEAST_SCORE) & in_countries & ~F.coalesce(evergreen, L(False)) & (age_days > MOST_AGE) & (age_days <= 2 * MOST_AGE), L(False))


def gates_before_memory(score: Column, in_countries: Column, age_days: Column, evergreen: Column, recent: Column, external_id: Column, monitored: Column) -> Column:
    """First of the gates that come before memory and hold a notification back; null if none does."""
    limit = F.when(evergreen | (recent >= HIRING), 2 * MOST_AGE).otherwise(MOST_AGE)
    return (
        F.when(score.isNull() | (score < LEAST_SCORE), "BELOW_SCORE").when(~F.coalesce(in_countries, L(False)), "OUTSIDE_COUNTRIES").when(age_days > limit, "TOO_OLD")
        .when(F.startswith(external_id, L(BOARD_COPY)) & monitored, "BOARD_COPY"))


def gates_after_memory(verdict: Column, acted: Column) -> Column:
    return F.when(F.coalesce(verdict != "APPLY", L(True)), "NOT_APPLY").when(acted, "ACTED_ON")


def remember(last: float | None, score: float | None, before: str | None, after: str | None) -> tuple[str | None, float | None]:
    """(why it is held back or null, score last told) after one event, from the score last told before it."""
    if before is not None:
        return before, last
    if last is not None and score < last + RISE:
        return "ALREADY_NOTIFIED", last
    if after is not None:
        return after, last
    return None, score


def _one_by_one(batch: pa.RecordBatch, new: np.ndarray, last: float | None) -> tuple[pa.Array, pa.Array, float | None]:
    holds, lasts = [], []
    for fresh, score, before, after in zip(new.tolist(), *(batch.column(c).to_pylist() for c in ("score", "before", "after")), strict=True):
        hold, last = remember(None if fresh else last, score, before, after)
        holds.append(hold)
        lasts.append(last)
    return pa.array(holds, pa.string()), pa.array(lasts, pa.float64()), last


def _at_once(batch: pa.RecordBatch, new: np.ndarray, last: float | None) -> tuple[pa.Array, pa.Array, float | None]:
    """``_one_by_one`` where all events that come to memory have a score: only events that no gate holds are gone through."""
    score, before, after = (batch.column(c) for c in ("score", "before", "after"))
    points, run = pc.fill_null(score, 0.0).to_numpy(), np.cumsum(new)
    free = np.flatnonzero(before.is_null().to_numpy(zero_copy_only=False) & after.is_null().to_numpy(zero_copy_only=False))
    told, first, now = [], last, 0
    for i, r, s in zip(free.tolist(), run[free].tolist(), points[free].tolist(), strict=True):
        if r != now:
            now, last = r, None
        if last is None or not s < last + RISE:
            told.append(i)
            last = s
    if now != run[-1]:
        last = None
    is_told = np.zeros(len(run), bool)
    is_told[told] = True
    # the event last told before each, if it is of the same user and job
    at = np.append(np.array(told, np.int64), -1)[np.cumsum(is_told) - is_told - 1]
    own = (at >= 0) & (run[at] == run)
    carried = ~own & (run == 0) & (first is not None)
    known, prior = own | carried, np.where(own, points[at], 0.0 if first is None else first)
    again = pa.array(known & (points < prior + RISE))
    holds = pc.coalesce(before, pc.if_else(again, pa.scalar("ALREADY_NOTIFIED"), after))
    return holds, pa.array(np.where(is_told, points, prior), mask=~(known | is_told)), last


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, last = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [pc.fill_null(batch.column(c), 0).to_numpy() for c in ("user_id", "job_id")]
        ids += [batch.column(c).is_null().to_numpy(zero_copy_only=False) for c in ("user_id", "job_id")]
        new = np.append(key != tuple(x[0] for x in ids), np.any([x[1:] != x[:-1] for x in ids], axis=0))
        key = tuple(x[-1] for x in ids)
        unscored = pc.any(pc.and_(batch.column("before").is_null(), batch.column("score").is_null())).as_py()
        holds, lasts, last = (_one_by_one if unscored else _at_once)(batch, new, last)
        columns = [batch.column(c) for c in ("user_id", "job_id", "event_id", "ts", "score")]
        yield pa.RecordBatch.from_arrays([*columns, holds, lasts], names=["user_id", "job_id", "event_id", "ts", "score", "hold_reason", "last_told"])


_INPUT = ("user_id", "job_id", "event_id", "ts", "score", "before", "after")


def decide(events: DataFrame) -> DataFrame:
    """hold_reason (null: told) and last_told for each event (user_id, job_id, event_id, ts, score, before, after), in order of (ts, event_id).

    A task streams its keys and holds one number, however many events a key has.
    """
    rows = events.select(F.col("user_id").cast("long"), F.col("job_id").cast("long"), F.col("event_id").cast("long"), F.col("ts").cast("timestamp"), F.col("score").cast("double"), "before", "after")
    return rows.repartition("user_id", "job_id").sortWithinPartitions("user_id", "job_id", "ts", "event_id").mapInArrow(_fold, DECIDED)


class Memory(StatefulProcessor):
    """The fold of ``decide`` on a stream: a value state for each key holds the score last told."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "score double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        mine = pd.concat(list(rows)).sort_values(["ts", "event_id"])  # a key's events of one micro-batch
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for user, job, event, ts, score, before, after in mine[list(_INPUT)].itertuples(index=False):
            score, before, after = (None if pd.isna(x) else x for x in (score, before, after))
            hold, last = remember(last, score, before, after)
            out.append((user, job, event, ts, score, hold, last))
        if last is not None:
            self.last.update((float(last),))
        yield pd.DataFrame(out, columns=["user_id", "job_id", "event_id", "ts", "score", "hold_reason", "last_told"])

    def close(self) -> None:
        pass


def decide_stream(events: DataFrame) -> DataFrame:
    """``decide`` on a stream whose micro-batches follow each other in time; needs the RocksDB state store (``state_store``)."""
    return events.select(*_INPUT).groupBy("user_id", "job_id").transformWithStateInPandas(statefulProcessor=Memory(), outputStructType=DECIDED, outputMode="Append", timeMode="None")


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def why_not(hold: Column, score: Column, told: Column) -> Column:
    """What a user is told who asks why no notification came (SCO-21)."""
    text = {
        "OUTSIDE_COUNTRIES": "Outside your countries.", "TOO_OLD": "Posted too long ago to interrupt you.", "BOARD_COPY": "Board copy held: the company is monitored and its own posting notifies.",
        "NOT_APPLY": "The verdict is not to apply now.", "ACTED_ON": "Already in your applications.",
    }
    said = F.when(hold == "BELOW_SCORE", F.concat(L("Score "), F.coalesce(F.format_number(score, 1), L("none")), L(f" is below {LEAST_SCORE}."))).when(hold == "ALREADY_NOTIFIED", F.concat(L("Told at "), F.format_number(told, 1), L(f"; tells again from {RISE} points more.")))
    for name, words in text.items():
        said = said.when(hold == name, words)
    return said.otherwise("You were notified.")


# --- digest (STR-9) --------------------------------------------------------------------

# Entries of a digest, and days a posting may be old to be in it.
DIGEST_SIZE, DIGEST_DAYS = 8, 30


def claim(candidates: DataFrame, claimed: DataFrame, size: int = DIGEST_SIZE) -> DataFrame:
    """(user_id, place, job_id, score): the best ``size`` of each user's candidates (user_id, job_id, score) that no run has claimed (user_id, job_id).

    Candidates repeated for a job count once, with their best score; ties go by job.
    """
    open_ = candidates.groupBy("user_id", "job_id").agg(F.max("score").alias("score")).join(claimed.select("user_id", "job_id").distinct(), ["user_id", "job_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc_nulls_last("score"), "job_id"))
    return open_.withColumn("place", place).where(F.col("place") <= size).select("user_id", "place", "job_id", "score")
