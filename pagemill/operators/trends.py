"""Trends, anomalies, usage patterns and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill import scale


def daily_series(events: DataFrame, topic: str, ts: str) -> DataFrame:
    """Share of each topic in the events of a day. After this aggregate a topic
    holds one row per day, so windows over it stay as short as the calendar. Events
    without a day or a topic count under a null of their own, which comes first in time."""
    per_day = events.groupBy(F.col(topic).alias("topic"), F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    totals = per_day.groupBy("day").agg(F.sum("n").alias("total"))
    return scale.join_null_safe(per_day, scale.maybe_broadcast(totals), ["day"]).select("topic", "day", (F.col("n") / F.col("total")).alias("popularity"))


def topic_trends(series: DataFrame, horizon: int = 7, n: int = 10) -> DataFrame:
    """Linear fit per topic with at least seven points and the mean forecast."""
    w = Window.partitionBy("topic").orderBy("day")
    x = series.withColumn("x", (F.row_number().over(w) - 1).cast("double"))
    fit = x.groupBy("topic").agg(
        F.count("*").alias("points"), F.max_by("popularity", "day").alias("current"), F.regr_slope("popularity", "x").alias("slope"),
        F.regr_intercept("popularity", "x").alias("intercept"), F.regr_r2("popularity", "x").alias("r2")).filter("points >= 7")
    mean_x = F.col("points") + (horizon - 1) / 2.0
    clamp = lambda c, lo: F.greatest(F.lit(lo), F.least(F.lit(1.0), c))
    return fit.select(
        "topic", F.round("current", 6).alias("current_popularity"), F.round(clamp(F.col("intercept") + F.col("slope") * mean_x, 0.0), 6).alias("predicted_popularity"),
        F.when(F.col("slope") > 0.01, "rising").when(F.col("slope") < -0.01, "falling").otherwise("stable").alias("trend_direction"),
        F.round(clamp(F.coalesce("r2", F.lit(0.0)), 0.1), 6).alias("confidence"),
    ).orderBy(F.col("confidence").desc(), F.col("predicted_popularity").desc(), "topic").limit(n)


# Topics that carry a factor of their own.
TOPIC_FACTORS = (("integration_demand", ("webhooks", "api")), ("automation_trend", ("workflows", "automation")))


def trend_factors(series: DataFrame) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("topic").orderBy(F.col("day").desc()))
    s = series.withColumn("back", back).filter("back <= 14")
    recent, older = F.col("back") <= 7, F.col("back") > 7
    stats = s.groupBy("topic").agg(
        F.avg(F.when(recent, F.col("popularity"))).alias("recent"), F.avg(F.when(older, F.col("popularity"))).alias("older"),
        F.stddev_pop(F.when(recent, F.col("popularity"))).alias("spread"))
    present = F.col("older").isNotNull()
    factors = F.array_compact(F.array(
        F.when(present & (F.col("recent") > F.col("older") * 1.1), "increasing_interest")
        .when(present & (F.col("recent") < F.col("older") * 0.9), "declining_interest"),
        F.when(present & (F.col("spread") > 0.1), "high_volatility"),
        *[F.when(F.col("topic").isin(*topics), name) for name, topics in TOPIC_FACTORS]))
    return stats.withColumn("factors", factors)


def week_windows(series: DataFrame) -> DataFrame:
    w = Window.partitionBy("topic").orderBy("day")
    return series.withColumns({
        "this_week": F.avg("popularity").over(w.rowsBetween(-6, 0)), "previous_week": F.avg("popularity").over(w.rowsBetween(-13, -7))})


def anomalies(points: DataFrame, metric: str, ts: str, value: str) -> DataFrame:
    """Points outside mean +/- two population deviations of their metric.

    The statistics come from a combined aggregate joined back, not from a window
    that would hold a whole metric in one task.
    """
    stats = points.groupBy(metric).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count("*").alias("_n")).filter("_n >= 10")
    joined = scale.join_null_safe(points, scale.maybe_broadcast(stats), [metric])
    v, low, high = F.col(value), F.col("_m") - 2 * F.col("_s"), F.col("_m") + 2 * F.col("_s")
    score = F.when(v < low, (low - v) / F.col("_s")).otherwise((v - high) / F.col("_s"))
    found = joined.filter((v < low) | (v > high)).withColumn("anomaly_score", F.round(score, 6))
    text = F.format_string("%s is unusually %s: %.2f (expected: %.2f)", F.coalesce(F.col(metric), F.lit("(unnamed)")), F.when(v > high, "high").otherwise("low"), F.round(v, 2), F.round("_m", 2))
    severity = F.when(F.col("anomaly_score") > 3, "high").when(F.col("anomaly_score") > 2, "medium").otherwise("low")
    return found.select(metric, ts, F.round(v, 6).alias("value"), "anomaly_score", severity.alias("severity"), text.alias("description"))


def severity_rank(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "medium", 2).when(c == "low", 1).otherwise(0)


def usage_pattern(events: DataFrame, key: str, ts: str, activity: Column) -> DataFrame:
    """Kind of variation of the daily means, and the mean activity."""
    daily = events.groupBy(key, F.to_date(ts).alias("day")).agg(F.avg(activity).alias("m"), F.sum(activity).alias("s"), F.count("*").alias("n"))
    out = daily.groupBy(key).agg(F.stddev_pop("m").alias("sd"), (F.sum("s") / F.sum("n")).alias("f"))
    kind = F.when(F.col("sd").isNull(), "insufficient_data").when(F.col("sd") < 0.1, "steady").when(F.col("sd") < 0.2, "moderate_variation").otherwise("high_variation")
    return out.select(key, kind.alias("pattern_type"), F.round("f", 6).alias("frequency"))


def peak_hours(events: DataFrame, key: str, ts: str, activity: Column) -> DataFrame:
    """Hours whose mean exceeds 1.2 times the mean of the hourly means; at most 24 per key."""
    hourly = events.groupBy(key, F.hour(ts).alias("hour")).agg(F.avg(activity).alias("m"))
    w = Window.partitionBy(key)
    return hourly.withColumn("all", F.avg("m").over(w)).filter(F.col("m") > F.col("all") * 1.2).groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list("hour")), ",").alias("peak_hours"))


def user_segments(events: DataFrame, user: str, power: int, casual: int) -> DataFrame:
    n = events.groupBy(user).agg(F.count("*").alias("n"))
    band = F.when(F.col("n") >= power, "power_users").when(F.col("n") >= casual, "casual_users").otherwise("new_users")
    return n.groupBy(band.alias("segment")).agg(F.count("*").alias("users"), F.sum("n").alias("events"))


WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def weekday_seasonality(events: DataFrame, ts: str, activity: Column) -> DataFrame:
    """Mean per weekday from one combined aggregate; absent days are 0.0."""
    day = F.date_format(F.col(ts).cast("timestamp"), "EEEE")
    means = events.select(day.alias("d"), activity.alias("a")).agg(*[F.coalesce(F.avg(F.when(F.col("d") == n, F.col("a"))), F.lit(0.0)).alias(n) for n in WEEKDAYS])
    pairs = ", ".join(f"'{n}', {n}" for n in WEEKDAYS)
    return means.select(F.expr(f"stack(7, {pairs}) AS (weekday, mean)"))


def recommend(content: DataFrame, preferred: list[str], level: str, n: int = 10) -> DataFrame:
    """content: content_id, title, category, complexity, views, searches, age_days, rating."""
    c = F.col("complexity")
    fits = {"beginner": c < 0.4, "intermediate": (c > 0.3) & (c < 0.7), "advanced": c > 0.6}[level]
    relevance = F.least(F.lit(1.0), F.lit(0.5) + F.when(F.col("category").isin(*preferred), 0.3).otherwise(0.0) + F.when(fits, 0.2).otherwise(0.0))
    scored = content.withColumns({
        "relevance": F.round(relevance, 6), "popularity": F.least(F.lit(1.0), (F.col("views") + F.col("searches")) / 1000),
        "freshness": F.greatest(F.lit(0.1), 1.0 - F.col("age_days") / 365)})
    combined = F.col("relevance") * 0.4 + F.col("popularity") * 0.3 + F.col("freshness") * 0.2 + F.col("rating") / 5.0 * 0.1
    why = F.concat_ws(" and ", F.when(F.col("popularity") > 0.7, "highly popular"), F.when(F.col("relevance") > 0.7, "highly relevant"),
                      F.when(F.col("age_days") < 30, "recently updated"), F.when(F.col("rating") > 4.5, "highly rated"))
    reason = F.when(why == "", "recommended based on overall score").otherwise(F.concat(F.lit("Recommended because it's "), why))
    return scored.select("content_id", "title", "relevance", F.round("popularity", 6).alias("popularity"), F.round("freshness", 6).alias("freshness"),
                         F.round(combined, 6).alias("combined"), reason.alias("reason")).orderBy(F.col("combined").desc(), "content_id").limit(n)
