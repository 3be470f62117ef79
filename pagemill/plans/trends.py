"""Trend, anomaly, usage and recommendation queries over events and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import trends as tr
from pagemill.plans.registry import query, table


def events(spark, sf):
    return table(spark, sf, "events")


def _series(spark, sf):
    return tr.daily_series(events(spark, sf).select("event_type", "ts"), "event_type", "ts")


_SERIES = """WITH n AS (SELECT event_type AS topic, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT topic, day, n / (sum(n) OVER (PARTITION BY day))::DOUBLE AS popularity FROM n)"""


@query("P1_topic_trend", _SERIES + """, x AS (SELECT *, (row_number() OVER (PARTITION BY topic ORDER BY day) - 1)::DOUBLE AS x FROM s),
f AS (SELECT topic, count(*) AS points, arg_max(popularity, day) AS cur, regr_slope(popularity, x) AS b, regr_intercept(popularity, x) AS a, regr_r2(popularity, x) AS r2 FROM x GROUP BY topic HAVING count(*) >= 7)
SELECT topic, round(cur, 6) AS current_popularity, round(greatest(0.0, least(1.0, a + b * (points + 3.0))), 6)::DOUBLE AS predicted_popularity, CASE WHEN b > 0.01 THEN 'rising' WHEN b < -0.01 THEN 'falling' ELSE 'stable' END AS trend_direction,
round(greatest(0.1, least(1.0, coalesce(r2, 0.0))), 6)::DOUBLE AS confidence FROM f ORDER BY confidence DESC, predicted_popularity DESC, topic LIMIT 10""")
def topic_trend(spark, sf):
    return tr.topic_trends(_series(spark, sf))


@query("P2_trend_factors", _SERIES + """, b AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY day DESC) AS back FROM s),
f AS (SELECT topic, avg(popularity) FILTER (back <= 7) AS recent, avg(popularity) FILTER (back BETWEEN 8 AND 14) AS older, stddev_pop(popularity) FILTER (back <= 7) AS spread FROM b GROUP BY topic)
SELECT topic, round(recent, 6) AS recent, round(older, 6) AS older, array_to_string(list_filter([CASE WHEN recent > older * 1.1 THEN 'increasing_interest' WHEN recent < older * 0.9 THEN 'declining_interest' END, CASE WHEN older IS NOT NULL AND spread > 0.1 THEN 'high_volatility' END], lambda x: x IS NOT NULL), '|') AS factors FROM f""")
def trend_factors(spark, sf):
    f = tr.trend_factors(_series(spark, sf))
    return f.select("topic", F.round("recent", 6).alias("recent"), F.round("older", 6).alias("older"), F.array_join("factors", "|").alias("factors"))


@query("P3_week_windows", _SERIES + " SELECT topic, day, round(avg(popularity) OVER (PARTITION BY topic ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS this_week, round(avg(popularity) OVER (PARTITION BY topic ORDER BY day ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING), 6) AS previous_week FROM s")
def week_windows(spark, sf):
    return tr.week_windows(_series(spark, sf)).select("topic", "day", F.round("this_week", 6).alias("this_week"), F.round("previous_week", 6).alias("previous_week"))


_ANOMALIES = """WITH p AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS hour, sum(value) AS v FROM events GROUP BY ALL), s AS (SELECT event_type, avg(v) AS m, stddev_pop(v) AS sd FROM p GROUP BY 1 HAVING count(*) >= 10),
a AS (SELECT event_type, hour, v, m, round(CASE WHEN v < m - 2 * sd THEN (m - 2 * sd - v) / sd ELSE (v - (m + 2 * sd)) / sd END, 6) AS anomaly_score, v > m + 2 * sd AS up FROM p JOIN s USING (event_type) WHERE v < m - 2 * sd OR v > m + 2 * sd),
z AS (SELECT event_type, hour, round(v, 6) AS value, anomaly_score, CASE WHEN anomaly_score > 3 THEN 'high' WHEN anomaly_score > 2 THEN 'medium' ELSE 'low' END AS severity, printf('%s is unusually %s: %.2f (expected: %.2f)', event_type, CASE WHEN up THEN 'high' ELSE 'low' END, round(v, 2), round(m, 2)) AS description FROM a)"""


def _anomalies(spark, sf):
    points = events(spark, sf).groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.sum("value").alias("v"))
    return tr.anomalies(points, "event_type", "hour", "v")


@query("P4_anomalies", _ANOMALIES + " SELECT * FROM z")
def anomalies(spark, sf):
    return _anomalies(spark, sf)


@query("L4_severity_sort", _ANOMALIES + " SELECT event_type, hour, severity, anomaly_score FROM z ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, anomaly_score DESC, event_type, hour LIMIT 50")
def severity_sort(spark, sf):
    a = _anomalies(spark, sf).select("event_type", "hour", "severity", "anomaly_score")
    return a.orderBy(tr.severity_rank(F.col("severity")).desc(), F.col("anomaly_score").desc(), "event_type", "hour").limit(50)


def _activity():
    return F.least(F.lit(1.0), F.col("value") / 100)


_ACT = "least(1.0, value / 100)::DOUBLE"


@query("P5_usage_pattern", f"""WITH d AS (SELECT user_id, ts::DATE AS day, avg({_ACT}) AS m, sum({_ACT}) AS s, count(*) AS n FROM events GROUP BY ALL), u AS (SELECT user_id, stddev_pop(m) AS sd, sum(s) / sum(n) AS f FROM d GROUP BY user_id)
SELECT user_id, CASE WHEN sd < 0.1 THEN 'steady' WHEN sd < 0.2 THEN 'moderate_variation' ELSE 'high_variation' END AS pattern_type FROM u""")
def usage_pattern(spark, sf):
    return tr.usage_pattern(events(spark, sf), "user_id", "ts", _activity()).select("user_id", "pattern_type")


@query("P6_usage_frequency", f"SELECT user_id, round(avg({_ACT}), 6) AS frequency FROM events GROUP BY user_id")
def usage_frequency(spark, sf):
    return tr.usage_pattern(events(spark, sf), "user_id", "ts", _activity()).select("user_id", "frequency")


@query("P7_peak_hours", f"""WITH h AS (SELECT event_type, hour(ts) AS hour, avg(value) AS m FROM events GROUP BY ALL), a AS (SELECT *, avg(m) OVER (PARTITION BY event_type) AS al FROM h)
SELECT event_type, string_agg(hour::VARCHAR, ',' ORDER BY hour) AS peak_hours FROM a WHERE m > al * 1.2 GROUP BY event_type""")
def peak_hours(spark, sf):
    return tr.peak_hours(events(spark, sf), "event_type", "ts", F.col("value"))


@query("P8_popular_topics", "SELECT event_type AS topic, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, topic LIMIT 3")
def popular_topics(spark, sf):
    return events(spark, sf).groupBy(F.col("event_type").alias("topic")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "topic").limit(3)


@query("P8_user_segments", "WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT CASE WHEN n >= 75 THEN 'power_users' WHEN n >= 60 THEN 'casual_users' ELSE 'new_users' END AS segment, count(*) AS users, sum(n)::BIGINT AS events FROM u GROUP BY 1")
def user_segments(spark, sf):
    return tr.user_segments(events(spark, sf), "user_id", 75, 60)


@query("P9_weekday_seasonality", "WITH c(weekday) AS (VALUES ('Monday'), ('Tuesday'), ('Wednesday'), ('Thursday'), ('Friday'), ('Saturday'), ('Sunday')) SELECT c.weekday, round(coalesce(avg(value), 0.0), 6)::DOUBLE AS mean FROM c LEFT JOIN events ON dayname(ts) = c.weekday GROUP BY 1")
def weekday_seasonality(spark, sf):
    return tr.weekday_seasonality(events(spark, sf), "ts", F.col("value")).select("weekday", F.round("mean", 6).alias("mean"))


_CONTENT = """WITH a AS (SELECT l_partkey, count(*) AS views, count(*) FILTER (l_returnflag = 'R') AS searches, date_diff('day', max(l_shipdate)::DATE, DATE '2001-12-31') AS age_days, avg(l_discount) AS d FROM lineitem GROUP BY 1),
c AS (SELECT p_partkey AS content_id, p_name AS title, p_type AS category, p_size / 50.0::DOUBLE AS complexity, coalesce(views, 0) * 40 AS views, coalesce(searches, 0) AS searches, coalesce(age_days, 365) AS age_days, 5 - coalesce(d, 0) * 20 AS rating FROM part LEFT JOIN a ON p_partkey = l_partkey),
s AS (SELECT *, round(least(1.0, 0.5 + CASE WHEN category IN ('ECONOMY', 'PROMO') THEN 0.3 ELSE 0 END + CASE WHEN complexity > 0.3 AND complexity < 0.7 THEN 0.2 ELSE 0 END), 6)::DOUBLE AS relevance, least(1.0, (views + searches) / 1000.0::DOUBLE) AS popularity, greatest(0.1, 1.0 - age_days / 365.0::DOUBLE) AS freshness FROM c)"""


@query("P10_content_recommendation", _CONTENT + """ SELECT content_id, title, relevance, round(popularity, 6)::DOUBLE AS popularity, round(freshness, 6)::DOUBLE AS freshness, round(relevance * 0.4::DOUBLE + popularity * 0.3::DOUBLE + freshness * 0.2::DOUBLE + rating / 5.0::DOUBLE * 0.1::DOUBLE, 6)::DOUBLE AS combined,
CASE WHEN NOT (popularity > 0.7 OR relevance > 0.7 OR age_days < 30 OR rating > 4.5) THEN 'recommended based on overall score' ELSE 'Recommended because it''s ' || concat_ws(' and ', CASE WHEN popularity > 0.7 THEN 'highly popular' END, CASE WHEN relevance > 0.7 THEN 'highly relevant' END, CASE WHEN age_days < 30 THEN 'recently updated' END, CASE WHEN rating > 4.5 THEN 'highly rated' END) END AS reason
FROM s ORDER BY combined DESC, content_id LIMIT 10""")
def recommendation(spark, sf):
    a = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.count("*").alias("v"), F.count_if(F.col("l_returnflag") == "R").alias("s"),
        F.date_diff(F.lit("2001-12-31").cast("date"), F.max("l_shipdate").cast("date")).alias("g"), F.avg("l_discount").alias("d"))
    p = table(spark, sf, "part")
    c = p.join(a, p.p_partkey == a.l_partkey, "left").select(
        F.col("p_partkey").alias("content_id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"), (F.col("p_size") / 50.0).alias("complexity"),
        (F.coalesce("v", F.lit(0)) * 40).alias("views"), F.coalesce("s", F.lit(0)).alias("searches"), F.coalesce("g", F.lit(365)).alias("age_days"), (5 - F.coalesce("d", F.lit(0.0)) * 20).alias("rating"))
    return tr.recommend(c, ["ECONOMY", "PROMO"], "intermediate")
