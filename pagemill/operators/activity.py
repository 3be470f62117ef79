"""Event state as batch jobs: rates, sessions, presence, logs, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import scale

SECOND = 1_000_000
HOUR = 3600 * SECOND


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def rate_counts(events: DataFrame, key: str, us: str, seconds: int, limit: int) -> DataFrame:
    """Arrivals in the last W seconds per key, (t - W, t], with the limit's verdict."""
    counted = scale.trailing_window(events, [key], us, seconds * SECOND, {
        "in_window": lambda w: F.count("*").over(w), "oldest": lambda w: F.min(us).over(w)})
    return counted.withColumns({
        "over_limit": F.col("in_window") > limit, "remaining": F.greatest(F.lit(0), limit - F.col("in_window")).cast("long"),
        "reset_us": F.col("oldest") + seconds * SECOND}).drop("oldest")


def split_at_gaps(events: DataFrame, key: str, us: str, gap_us: int, tie: str, width: int | None = None, inclusive: bool = False) -> DataFrame:
    """Adds `session`: rows of a key belong together until a pause longer than the gap.

    The previous time and the running number are found inside time segments and
    carried across them, so a very active key is spread over many tasks.
    """
    width = width or scale.segment_width(events, [key], us)
    lagged = scale.with_previous(events, [key], us, width, tie)
    pause = F.col(us) - F.col("prev")
    new = F.when(F.col("prev").isNull() | ((pause >= gap_us) if inclusive else (pause > gap_us)), 1).otherwise(0)
    return scale.running_sum(lagged, [key], us, width, tie, new, "session").drop("prev")


def presence_sessions(events: DataFrame, key: str, us: str, tie: str, idle_minutes: int = 30) -> DataFrame:
    rows = split_at_gaps(events, key, us, idle_minutes * 60 * SECOND, tie)
    return rows.groupBy(key, "session").agg(F.min(us).alias("start_us"), F.max(us).alias("end_us"), F.count("*").alias("events"))


def limiter_stats(events: DataFrame, key: str, us: str) -> DataFrame:
    """Requests of the last minute and hour before each key's latest event."""
    latest = events.groupBy(key).agg(F.max(us).alias("latest"))
    recent = scale.join_null_safe(events, latest, [key]).filter(F.col(us) > F.col("latest") - HOUR)
    return recent.groupBy(key).agg(F.count_if(F.col(us) > F.col("latest") - 60 * SECOND).alias("minute_requests"), F.count("*").alias("hour_requests"))


def active_members(events: DataFrame, doc: str, user: str, joined: Column, left: Column, order: Column) -> DataFrame:
    """(document, user) rows whose last join or leave event is a join."""
    moves = events.filter(joined | left)
    last = moves.groupBy(doc, user).agg(F.max_by(joined, order).alias("in"))
    return last.filter("in").select(doc, user)


def document_state(events: DataFrame, doc: str, members: DataFrame, kinds: dict[str, Column], order: Column, item: str) -> DataFrame:
    """Count and newest item per document and kind, members included."""
    kind = None
    for name, test in kinds.items():
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    items = events.withColumn("kind", kind).filter("kind IS NOT NULL").groupBy(doc, "kind").agg(F.count("*").alias("n"), F.max_by(item, order).alias("latest"))
    users = members.groupBy(doc).agg(F.count("*").alias("n")).select(doc, F.lit("user").alias("kind"), "n", F.lit(None).cast("bigint").alias("latest"))
    return items.unionByName(users)


def bounded_log(events: DataFrame, key: str, newest_first: list[Column], n: int = 1000) -> DataFrame:
    """Newest n rows per key; map tasks forward at most n rows per key."""
    return scale.top_n_per_key(events, [key], newest_first, n)


def newest(events: DataFrame, newest_first: list[Column], n: int = 1000) -> DataFrame:
    return events.orderBy(*newest_first).limit(n)


def live_entries(entries: DataFrame, expires: str, now: Column) -> DataFrame:
    return entries.filter(F.col(expires).isNull() | (F.col(expires) >= now))


def access_counters(events: DataFrame, key: str, ts: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("access_count"), F.max(ts).alias("last_accessed"))


def history_blocks(turns: DataFrame, key: str, turn: str, fields: list[str], block: int | None = None) -> DataFrame:
    """The ordered turns of each session; with `block`, in rows of so many turns."""
    if block is not None:
        turns = turns.withColumn("block", F.floor(F.col(turn) / block).cast("long"))
    return turns.groupBy(key, *([] if block is None else ["block"])).agg(F.array_sort(F.collect_list(F.struct(turn, *fields))).alias("turns"))


def question_answer_pairs(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """User turn directly followed by an assistant turn."""
    lagged = scale.with_previous(turns, [key], turn, 10_000, turn)
    asked = turns.filter(F.col(role) == "user").select(key, F.col(turn).alias("prev"), F.col(text).alias("question"))
    answers = lagged.filter(F.col(role) == "assistant").select(key, turn, "prev", F.col(text).alias("answer"))
    return scale.join_null_safe(answers, asked, [key, "prev"]).select(key, turn, "question", "answer")
