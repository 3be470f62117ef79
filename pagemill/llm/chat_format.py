"""Reply trees to conversations: root-to-leaf paths by self-joins, formatted best path.

Every message names its parent. Self-joins double the reach of the pointers: after round r
each message knows its ancestor 2^r steps up and the score and length of the way there, so
the paths of a tree of depth d are known after about log2(d) joins. The leaves are ranked
by the score of their path; the best leaf of a conversation marks its ancestors by walking
the same pointers down from the largest. The marked messages form one conversation.

Template: `<|turn|>` role, newline, text, `<|end|>`, newline, for each turn. In roles and
texts a backslash follows every `<`, `[` and backslash, so no control string survives
there, and removing those backslashes gives the text back. A newline in a role becomes
`[n`. The loss mask lists the places of the assistant texts in the formatted string.

Defined results: null text or role is empty; a null conversation is one conversation; of
repeated message ids the least (parent, role, text) stays; a message whose parent is
missing is a root; messages on a cycle belong to no path; ties between leaves go to the
longer path, then the smaller id. A conversation is one row, so its text must fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import discard, stored

TURN, END = "<|turn|>", "<|end|>\n"
SPECIAL = r"([<\[\\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, SPECIAL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, SPECIAL + r"\\", "$1")


def best_paths(messages: DataFrame, conv: str = "conv_id", node: str = "message_id", parent: str = "parent_id", score: str = "score") -> DataFrame:
    """(conv, node, depth, path_score) of the messages on each conversation's best path."""
    given = messages.select(F.col(conv).alias("conv"), F.col(node).alias("id"), F.col(parent).alias("up"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("s"))
    given = stored(given.filter("id IS NOT NULL"))
    known = given.select(F.col("id").alias("up"), F.lit(True).alias("_there"))
    first = given.join(known, "up", "left").select("conv", "id", F.when(F.col("_there"), F.col("up")).alias("up"), "s", F.lit(1).cast("long").alias("n"))
    state = stored(first)
    active, whole, rounds, most = state.filter("up IS NOT NULL"), state.filter("up IS NULL"), [], given.count()
    while (1 << len(rounds)) <= 2 * most and active.limit(1).count():
        # only pointers that have not reached a root jump on
        rounds.append(active)
        above = active.unionByName(whole).select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("s").alias("_s"), F.col("n").alias("_n"))
        jumped = stored(active.join(above, "up").select("conv", "id", F.col("_up").alias("up"), (F.col("s") + F.col("_s")).alias("s"), (F.col("n") + F.col("_n")).alias("n")))
        active, whole = jumped.filter("up IS NOT NULL"), whole.unionByName(jumped.filter("up IS NULL"))
    parents = state.select(F.col("up").alias("id")).filter("id IS NOT NULL").distinct()
    leaves = whole.join(parents, "id", "left_anti")
    ranked = Window.partitionBy("conv").orderBy(F.desc("s"), F.desc("n"), "id")
    best = leaves.withColumn("_r", F.row_number().over(ranked)).filter("_r = 1").select("id", F.col("s").alias("path_score"))
    marked = stored(best)
    for pointers in reversed(rounds):
        hops = marked.join(pointers.select("id", "up"), "id").select(F.col("up").alias("id"), "path_score")
        grown = stored(marked.unionByName(hops))
        discard(marked)
        marked = grown
    # depth of a message: length of its own way to the root
    return marked.join(whole.select("id", "conv", "n"), "id").select(
        F.col("conv").alias(conv), F.col("id").alias(node), F.col("n").alias("depth"), "path_score")


def conversations(messages: DataFrame, conv: str = "conv_id", node: str = "message_id", parent: str = "parent_id", role: str = "role",
                  text: str = "text", score: str = "score", learned: str = "assistant") -> DataFrame:
    """One row per conversation: conv, n_turns, formatted, loss_spans (start, length; from 1), path_score."""
    rest = F.struct(F.col(parent).cast("string").alias("_p"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    picked = messages.filter(F.col(node).isNotNull()).groupBy(F.col(conv).alias("conv"), F.col(node).alias("id"), F.col(parent).alias("up")).agg(
        F.min(rest).alias("_m"), F.max(F.coalesce(F.col(score).cast("double"), F.lit(0.0))).alias("s"))
    path = best_paths(picked, "conv", "id", "up", "s")
    turns = path.join(picked.select("id", "_m.role", "_m.text"), "id")
    head = F.concat(F.lit(TURN), F.regexp_replace(escaped(F.col("role")), "\n", "[n"), F.lit("\n"))
    turns = turns.select("conv", "depth", "path_score", "role", head.alias("head"), escaped(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + F.lit(len(END))
    before = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head") + 1
    learn = F.when(F.col("role") == learned, F.struct(F.col("start").cast("int").alias("start"), F.length("body").alias("length")))
    row = F.struct("depth", F.concat("head", "body", F.lit(END)).alias("written"), learn.alias("learn"))
    gathered = turns.withColumn("start", start).groupBy("conv").agg(F.array_sort(F.collect_list(row)).alias("t"), F.max("path_score").alias("path_score"))
    return gathered.select(
        F.col("conv").alias(conv), F.size("t").cast("long").alias("n_turns"), F.array_join("t.written", "").alias("formatted"),
        F.filter("t.learn", lambda x: x.isNotNull()).alias("loss_spans"), "path_score")


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    parts = F.slice(F.split(formatted, r"<\|turn\|>", -1), 2, 2_000_000_000)

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        body = part.substr(F.length(head) + 2, F.length(part) - F.length(head) - F.lit(1 + len(END)))
        return F.struct(unescaped(F.regexp_replace(head, r"\[n", "\n")).alias("role"), unescaped(body).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescaped(formatted.substr(s["start"], s["length"]))), "")


def chained(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows of linear conversations as a reply tree: each message replies to the one before."""
    order = Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first())
    name = F.coalesce(F.col(conv).cast("string"), F.lit("none"))
    numbered = rows.select(conv, role, text, F.row_number().over(order).alias("_n"))
    return numbered.select(
        conv, role, text, F.concat_ws(":", name, F.col("_n").cast("string")).alias("message_id"),
        F.when(F.col("_n") > 1, F.concat_ws(":", name, (F.col("_n") - 1).cast("string"))).alias("parent_id"), F.lit(0.0).alias("score"))
