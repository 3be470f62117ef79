"""Quality rules by robust multivariate outliers.

Each document gives a vector of transformed statistics: mean word length, symbols per
word (log), share of repeated lines (log), share of repeated three-word windows. For every
language and source the minimum-covariance-determinant estimate of centre and scatter is
found by concentration steps: keep the share `inner` of the rows that lie nearest, take
their mean and covariance, and repeat until no determinant falls any more. Every group is
estimated from each of STARTS, which rank the rows by different distances from medians and
by the plain covariance; the estimate of least determinant stays. A document goes when its
squared Mahalanobis distance passes the chi-square value of `level`.

Scatter never falls below `floors` per statistic, so a source whose documents all agree
in one statistic stays measurable. Sources with fewer than `least` usable rows share one
estimate per language. Estimates are a few numbers per group, gathered by aggregates with
map-side combine; nearness cuts come from counts of logarithmic distance bins. They are
broadcast only where their rows are counted to be few, and joined by a shuffle elsewhere.

Only DataFrame functions run here. Defined results: a null text has no words and fails the
base rules; null language or source is a group of its own; repeated rows count and are
judged each; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import discard, stored

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
DIMS = ("x0", "x1", "x2", "x3")
STARTS = 4  # ways to rank the rows of a group before the first step
GROUPS = 50_000  # rows of estimates (about 20 numbers each) that may be broadcast


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    given = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    words = F.regexp_extract_all("_t", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    cut = given.withColumns({"_w": words, "_l": lines})
    windows = F.when(F.size("_w") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.struct(
        F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i")))))
    sorted_ = cut.withColumn("_s", windows)
    twice = F.filter("_s", lambda x, i: (F.get("_s", i - 1)["h"] == x["h"]) | (F.get("_s", i + 1)["h"] == x["h"]))
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    begin = F.struct(F.lit(-3).alias("p"), F.lit(0).alias("n"))
    covered = F.aggregate(starts, begin, lambda a, x: F.struct(x.alias("p"), (a["n"] + F.least(F.lit(3), x - a["p"])).alias("n")), lambda a: a["n"])
    return sorted_.select(
        *keep, F.size("_w").cast("long").alias("n_words"), F.length(F.translate("_t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def vector() -> dict[str, Column]:
    """Transformed statistics of a row, by dimension."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "x0": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), "x1": F.log1p(20 * F.col("n_symbols") / n),
        "x2": F.log1p(5 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), "x3": F.col("n_repeat_words") / n,
    }


def chi_square(x: float, dof: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))


def chi_square_at(level: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dof) < level else (low, mid)
    return high


def few(side: DataFrame, rows: int = GROUPS) -> DataFrame:
    """Broadcast hint where the stored side is counted to be small, else left to shuffle."""
    return F.broadcast(side) if side.count() <= rows else side


def triangle(cov: list[list[Column]]) -> dict[str, Column]:
    """Cholesky factor of a covariance, as named columns (each uses earlier ones)."""
    out: dict[str, Column] = {}
    for i in range(len(DIMS)):
        for j in range(i + 1):
            rest = cov[i][j]
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out[f"l{i}{j}"] = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}")
    return out


def moments(rows: DataFrame, floors: tuple[float, ...], factor: float) -> DataFrame:
    """Mean m* and Cholesky factor l* of each group, scatter raised to the floors."""
    pairs = [(i, j) for i in range(len(DIMS)) for j in range(i + 1)]
    out = rows.groupBy("g").agg(*[F.avg(d).alias(f"m{i}") for i, d in enumerate(DIMS)], *[F.covar_pop(DIMS[i], DIMS[j]).alias(f"c{i}{j}") for i, j in pairs])
    cov = [[F.col(f"c{i}{j}") * factor + (floors[i] ** 2 if i == j else 0.0) for j in range(i + 1)] for i in range(len(DIMS))]
    for name, column in triangle(cov).items():
        out = out.withColumn(name, column)
    return out.drop(*[f"c{i}{j}" for i, j in pairs])


def distance() -> Column:
    """Squared Mahalanobis distance of the x columns by the m and l columns, by forward substitution."""
    parts: list[Column] = []
    for i, d in enumerate(DIMS):
        rest = F.col(d) - F.col(f"m{i}")
        for k, part in enumerate(parts):
            rest = rest - F.col(f"l{i}{k}") * part
        parts.append(rest / F.col(f"l{i}{i}"))
    return sum((p * p for p in parts[1:]), parts[0] * parts[0])


def nearest(rows: DataFrame, inner: float) -> DataFrame:
    """Rows of each group whose distance bin lies within the share `inner`."""
    binned = rows.withColumn("bin", F.floor(F.log2(F.col("d") + 1e-9) * 16))
    counts = binned.groupBy("g", "bin").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy("g"))
    cuts = counts.withColumn("_u", upto).withColumn("_t", total).filter(F.col("_u") >= F.col("_t") * inner).groupBy("g").agg(F.min("bin").alias("cut"))
    return binned.join(few(stored(cuts)), "g").filter(F.col("bin") <= F.col("cut"))


def starts(rows: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """Rows (g, x*, d) of every start, g carrying the number of the start.

    From medians and median deviations: sum of squares, largest part, and a bounded sum that
    far rows cannot pull; and the distance by the mean and covariance of all rows.
    """
    mid = stored(rows.groupBy("g").agg(*[F.percentile_approx(d, 0.5, 1000).alias(f"m{i}") for i, d in enumerate(DIMS)]))
    off = rows.join(few(mid), "g")
    spread = stored(off.groupBy("g").agg(*[F.percentile_approx(F.abs(F.col(d) - F.col(f"m{i}")), 0.5, 1000).alias(f"s{i}") for i, d in enumerate(DIMS)]))
    z2 = [((F.col(d) - F.col(f"m{i}")) / (F.lit(1.4826) * F.col(f"s{i}") + floors[i])) ** 2 for i, d in enumerate(DIMS)]
    robust = off.join(few(spread), "g").select("g", *DIMS, F.array(sum(z2[1:], z2[0]), F.greatest(*z2), sum((z / (1 + z) for z in z2[1:]), z2[0] / (1 + z2[0]))).alias("all"))
    plain = rows.join(few(stored(moments(rows, floors, 1.0))), "g").select("g", *DIMS, distance().alias("d"))
    numbered = robust.select("g", *DIMS, F.posexplode("all").alias("start", "d")).unionByName(plain.withColumn("start", F.lit(3)))
    return numbered.select(F.struct("g", "start").alias("g"), *DIMS, "d")


def log_determinant() -> Column:
    return sum((F.log(f"l{i}{i}") for i in range(1, len(DIMS))), F.log("l00")) * 2


def estimates(rows: DataFrame, floors: tuple[float, ...], inner: float, steps: int) -> DataFrame:
    """MCD centre, Cholesky factor and log determinant of each group g of the rows (g, x*)."""
    placed, every = starts(rows, floors), rows.withColumn("start", F.explode(F.array(*[F.lit(i) for i in range(STARTS)]))).select(F.struct("g", "start").alias("g"), *DIMS)
    cut = chi_square_at(inner, len(DIMS))
    factor, before, found = inner / chi_square(cut, len(DIMS) + 2), None, None
    for _ in range(steps):
        following = stored(moments(nearest(placed, inner), floors, factor).withColumn("logdet", log_determinant()))
        total = following.agg(F.round(F.sum("logdet"), 6)).first()[0]
        if found is not None:
            discard(found)
        found = following
        if total is None or (before is not None and total >= before):
            break
        before = total
        placed = every.join(few(found.drop("logdet")), "g").select("g", *DIMS, distance().alias("d"))
    rest = [c for c in found.columns if c != "g"]
    best = found.groupBy(F.col("g.g").alias("g")).agg(F.min_by(F.struct(*rest), F.struct("logdet", F.col("g.start"))).alias("b"))
    return stored(best.select("g", *[F.col("b")[c].alias(c) for c in rest]))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", floors: tuple[float, ...] = (0.1, 0.25, 0.25, 0.1),
          inner: float = 0.75, steps: int = 10, least: int = 40, level: float = 1 - 1e-9) -> DataFrame:
    """key, the statistics, base_failed, kept and distance of every row."""
    raw = docs.select(F.col(key).alias("_key"), F.col(lang).cast("string").alias("_lang"), F.col(source).cast("string").alias("_source"), F.col(text).alias("_text"))
    counted = statistics(raw, ["_key", "_lang", "_source"], "_text")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    rows = stored(counted.withColumns({**vector(), "base_failed": failed}))
    sizes = stored(rows.groupBy("_lang", "_source").agg(F.count_if(~F.col("base_failed")).alias("_n")))
    group = F.struct(F.col("_lang").alias("lang"), F.when(F.col("_n") >= least, F.col("_source")).alias("source"), (F.col("_n") >= least).alias("own"))
    of = sizes.select(F.col("_lang").alias("_l"), F.col("_source").alias("_s"), F.to_json(group).alias("g"))
    same = F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s"))
    grouped = stored(rows.join(few(stored(of)), same).drop("_l", "_s", "_lang", "_source"))
    found = estimates(grouped.filter(~F.col("base_failed")).select("g", *DIMS), floors, inner, steps)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = grouped.join(few(found.drop("logdet")), "g", "left").withColumn("distance", distance())
    near = F.coalesce(F.col("distance") <= chi_square_at(level, len(DIMS)), F.lit(True))
    discard(sizes)
    return judged.select(F.col("_key").alias(key), *names, (~F.col("base_failed") & near).alias("kept"), "distance")
