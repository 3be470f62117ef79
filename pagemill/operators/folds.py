"""Decisions that depend on every earlier decision of a key.

Rows are cut where the state provably starts afresh, or summarised per segment,
sent to tasks by (key, part) and folded in order with the state carried from one
Arrow batch to the next; no group is ever gathered.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.activity import SECOND, split_at_gaps
from pagemill.scale import join_null_safe, segment_of, segment_width


def ordered_fold(df: DataFrame, parts: list[str], order: list[str], start: Callable, step: Callable, schema: str, carry: list[str]) -> DataFrame:
    """Applies state = step(state, row) -> (state, outputs) along each part in order.

    start(row) gives the state at the first row of a part.
    """
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    kept = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                this = tuple(None if pd.isna(v) else v for v in (getattr(row, p) for p in parts))
                if this != part:
                    part, state = this, start(row)
                state, values = step(state, row)
                out.append(tuple(getattr(row, c) for c in carry) + values)
            yield pd.DataFrame(out, columns=carry + names)

    placed = df.repartition(*[F.col(p) for p in parts]).sortWithinPartitions(*parts, *order)
    return placed.mapInPandas(run, f"{kept}, {schema}")


def token_bucket(events: DataFrame, key: str, us: str, tie: str, capacity: float, rate: float) -> DataFrame:
    """Allow when a token is left. A pause of capacity / rate seconds fills the
    bucket whatever came before, so the events between such pauses are independent."""
    parted = split_at_gaps(events.select(key, us, tie), key, us, int(capacity / rate * SECOND), tie, inclusive=True)

    def start(row):
        return capacity, getattr(row, us)

    def step(state, row):
        tokens, last = state
        now = getattr(row, us)
        tokens = min(capacity, tokens + (now - last) / SECOND * rate)
        allowed = tokens >= 1
        tokens -= 1 if allowed else 0
        return (tokens, now), (allowed, tokens)

    return ordered_fold(parted, [key, "session"], [us, tie], start, step, "allowed boolean, tokens double", [key, us, tie])


def sliding_log(events: DataFrame, key: str, us: str, tie: str, seconds: int, limit: int) -> DataFrame:
    """Allow when fewer than `limit` allowed requests lie in (t - W, t]; rejected
    ones are not recorded. A pause of W seconds empties the log."""
    span = seconds * SECOND
    parted = split_at_gaps(events.select(key, us, tie), key, us, span, tie, inclusive=True)

    def step(log, row):
        now = getattr(row, us)
        while log and log[0] <= now - span:
            log.popleft()
        allowed = len(log) < limit
        if allowed:
            log.append(now)
        return log, (allowed, limit - len(log), log[0] + span)

    return ordered_fold(parted, [key, "session"], [us, tie], lambda row: deque(), step, "allowed boolean, remaining long, reset_us long", [key, us, tie])


# Successes per step down, factors and caps of the adaptive delay.
RUN_LENGTH = 5
FACTORS = {"success": 0.9, "rate_limit": 2.0, "failure": 1.5}
CAPS = {"rate_limit": 300.0, "failure": 60.0}


def delay_step(outcome: str, count: int, initial: float) -> tuple[int, tuple[float, float, float]]:
    """New success count and the change of the delay as (factor, least, most)."""
    if outcome != "success":
        return 0, (FACTORS[outcome], 0.0, CAPS[outcome])
    if count + 1 < RUN_LENGTH:
        return count + 1, (1.0, 0.0, float("inf"))
    return 0, (FACTORS["success"], initial, float("inf"))


def apply_change(change: tuple[float, float, float], delay: float) -> float:
    factor, least, most = change
    return min(most, max(least, factor * delay))


def compose(first: tuple[float, float, float], then: tuple[float, float, float]) -> tuple[float, float, float]:
    """Bounded scalings are closed under composition."""
    return first[0] * then[0], apply_change(then, first[1]), apply_change(then, first[2])


def adaptive_delay(events: DataFrame, key: str, us: str, tie: str, outcome: str, initial: float = 1.0, width: int | None = None) -> DataFrame:
    """Delay after each outcome (success, rate_limit, failure).

    The delay never starts afresh, so a key is cut into time segments: each
    segment is summarised for every possible success count at its start, the
    summaries of a key are chained, and the segments are then folded in parallel.
    """
    rows = events.select(key, us, tie, outcome).withColumn("seg", segment_of(F.col(us), width or segment_width(events, [key], us)))
    key_type = events.schema[key].dataType.simpleString()

    def summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, maps = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                this = (None if pd.isna(getattr(row, key)) else getattr(row, key), row.seg)
                if this != part:
                    if part is not None:
                        out.append((*part, *flat(maps)))
                    part, maps = this, [(c, (1.0, 0.0, float("inf"))) for c in range(RUN_LENGTH)]
                for c0, (count, change) in enumerate(maps):
                    nxt, now = delay_step(getattr(row, outcome), count, initial)
                    maps[c0] = (nxt, compose(change, now))
            yield pd.DataFrame(out, columns=[key, "seg", "counts", "factors", "leasts", "mosts"])
        if part is not None:
            yield pd.DataFrame([(*part, *flat(maps))], columns=[key, "seg", "counts", "factors", "leasts", "mosts"])

    def flat(maps):
        return [m[0] for m in maps], [m[1][0] for m in maps], [m[1][1] for m in maps], [m[1][2] for m in maps]

    placed = rows.repartition(key, "seg").sortWithinPartitions(key, "seg", us, tie)
    summary = placed.mapInPandas(summarize, f"{key} {key_type}, seg long, counts array<long>, factors array<double>, leasts array<double>, mosts array<double>")

    def chain(state, row):
        count, delay = state
        change = (row.factors[count], row.leasts[count], row.mosts[count])
        return (int(row.counts[count]), apply_change(change, delay)), (count, delay)

    starts = ordered_fold(summary, [key], ["seg"], lambda row: (0, initial), chain, "start_count long, start_delay double", [key, "seg"])

    def step(state, row):
        count, delay = state
        count, change = delay_step(getattr(row, outcome), count, initial)
        delay = apply_change(change, delay)
        return (count, delay), (delay,)

    return ordered_fold(join_null_safe(rows, starts, [key, "seg"]), [key, "seg"], [us, tie], lambda row: (int(row.start_count), row.start_delay), step, "delay double", [key, us, tie])
