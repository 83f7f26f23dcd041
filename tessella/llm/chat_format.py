"""Chat formatting into budgeted windows (DataFrame functions only).

Template of a turn: `### <role>: <text></turn>\\n`. In roles and texts the backslash, `#`, `<` and, in roles,
`:` are written as a backslash and a letter, so no control string can stand inside a text and every
sequence is undone exactly.

Prefix sums of turn tokens (a quarter of the written code points, rounded up) choose turn-aligned windows
of at most BUDGET tokens. Every window begins with the conversation's system turns: with all of them where they fit into three
quarters of the budget, else with as many of the last ones as do, and the others stand at their own place alone, as other turns do. So the
output is at most about ten times the input, however many and long system turns are. Then come those last
turns of the window before it that fit into HISTORY tokens (a quarter of what the system turns leave, if that
is less, and no more than the window's own turns leave). Both are repeats and carry no loss. What is left of
the budget, the room, is for own turns: a turn of more than half the room has a window to itself, the others
between two such turns are cut where the running sum passes a multiple of half the room. Only the window's
own assistant turns are under the loss mask, so each is a target once.

Columns of a window: conv_id, window (from 0), text, n_repeated (turns before the own ones), loss (array of
0-based start and end code points in text).

Defined cases: null text and null role are empty; null conv_id is a conversation of its own; ties of turn are
ordered by role and text; repeated rows are repeated turns; an empty table has no window; other columns
are ignored. A window exceeds its budget only where a single own turn does, on top of what is repeated. Running sums
hold sizes alone and go by SPAN turn numbers first, then over the spans of a conversation, so a long
conversation is spread over tasks; texts, however long, meet only in their windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.session import materialize

BUDGET, HISTORY, SPAN = 1024, 256, 1024
#: The share of the budget that repeated system turns may take, as a fraction.
SYSTEM = (3, 4)
END = "</turn>\n"
#: Each control character and the letter that stands for it after a backslash. The backslash is written first and read last.
CONTROLS = (("\\", "b"), ("#", "h"), ("<", "l"), (":", "c"))


def escape(text: Column, role: bool = False) -> Column:
    for char, letter in CONTROLS[: 4 if role else 3]:
        text = F.replace(text, F.lit(char), F.lit("\\" + letter))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for char, letter in reversed(CONTROLS[: 4 if role else 3]):
        text = F.replace(text, F.lit("\\" + letter), F.lit(char))
    return text


def _head(role: Column) -> Column:
    return F.concat(F.lit("### "), escape(role, True), F.lit(": "))


def _placed(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """(conv, id, system, size, window, pos): sizes of all turns (conv, turn, id, role, size, tie) and where they go."""
    share = budget * SYSTEM[0] // SYSTEM[1]
    # The last system turns that fit; a turn has a token at least, so only the last `share` of them are looked at.
    late = W.partitionBy("conv").orderBy(F.desc("turn"), F.desc("tie"), F.desc("id"))
    last = rows.filter(F.col("role") == "system").withColumn("k", F.row_number().over(late)).filter(F.col("k") <= share)
    last = last.withColumn("tail", F.sum("size").over(late.rowsBetween(W.unboundedPreceding, 0))).filter(F.col("tail") <= share)
    fixed = last.groupBy(F.col("conv").alias("c")).agg(F.sum("size").alias("fixed"), F.collect_list("id").alias("repeated"))
    rows = rows.withColumn("span", F.floor(F.col("turn") / SPAN)).join(fixed, F.col("conv").eqNullSafe(F.col("c")), "left").drop("c")
    rows = rows.withColumn("system", F.coalesce(F.array_contains("repeated", F.col("id")), F.lit(False))).withColumn("fixed", F.coalesce("fixed", F.lit(0).cast("long"))).drop("repeated")
    left = F.greatest(F.lit(budget) - F.col("fixed"), F.lit(1))
    rows = rows.withColumn("past", F.least(F.lit(history), F.floor(left / 4))).withColumn("room", F.greatest(left - F.col("past"), F.lit(1)))
    rows = rows.withColumn("large", (~F.col("system") & (2 * F.col("size") > F.col("room"))).cast("long"))
    rows = rows.withColumn("part", F.when(F.col("system") | (F.col("large") == 1), F.lit(0)).otherwise(F.col("size")))
    # Running sums before each turn: within spans of turn numbers, then over the spans.
    inner = W.partitionBy("conv", "span").orderBy("turn", "tie", "id").rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy("conv").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    sums = {"part": "before", "large": "larger", "one": "pos"}
    rows = rows.withColumn("one", F.lit(1).cast("long"))
    spans = rows.groupBy("conv", "span").agg(*(F.sum(x).alias(f"all_{x}") for x in sums))
    spans = spans.select("conv", "span", *(F.coalesce(F.sum(f"all_{x}").over(outer), F.lit(0)).alias(f"base_{x}") for x in sums))
    rows = rows.select("*", *(F.coalesce(F.sum(x).over(inner), F.lit(0)).alias(f"in_{x}") for x in sums))
    rows = rows.join(spans, rows["conv"].eqNullSafe(spans["conv"]) & rows["span"].eqNullSafe(spans["span"])).drop(spans["conv"], spans["span"])
    rows = rows.select("*", *((F.col(f"base_{x}") + F.col(f"in_{x}")).alias(y) for x, y in sums.items()))
    # Large turns and what stands between them alternate; half a room each time in what stands between.
    rows = rows.withColumn("seg", 2 * F.col("larger") + F.col("large")).withColumn("cut", F.floor(2 * F.col("before") / F.col("room")))
    found = rows.select("conv", "seg", "cut").distinct()
    found = found.select("conv", "seg", "cut", (F.row_number().over(W.partitionBy("conv").orderBy("seg", "cut")) - 1).cast("long").alias("window"))
    rows = rows.join(found, rows["conv"].eqNullSafe(found["conv"]) & (rows["seg"] == found["seg"]) & (rows["cut"] == found["cut"])).drop(found["conv"])
    return rows.select("conv", "id", "system", "size", "window", "pos", "fixed", "past")


def _copies(placed: DataFrame, budget: int) -> DataFrame:
    """(conv, window, kind, pos, id): own turns (2), history (1) and system turns (0) of each window."""
    own = placed.select("conv", "window", F.lit(2).alias("kind"), "pos", "id")
    tokens = F.sum(F.when(F.col("system"), 0).otherwise(F.col("size")))
    spans = placed.groupBy("conv", "window").agg(tokens.alias("tokens"), F.first("fixed").alias("fixed"), F.first("past").alias("past"))
    room = spans.select(F.col("conv").alias("c"), (F.col("window") - 1).alias("w"), F.greatest(F.least("past", F.lit(budget) - F.col("fixed") - F.col("tokens")), F.lit(0)).alias("room"))
    # A window's turns are few, so its running sum is a small partition.
    back = W.partitionBy("conv", "window").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0)
    late = placed.filter("not system").withColumn("tail", F.sum("size").over(back)).filter("tail <= past")
    seen = late.join(room, late["conv"].eqNullSafe(room["c"]) & (late["window"] == room["w"])).filter("tail <= room").select("conv", (F.col("window") + 1).alias("window"), F.lit(1).alias("kind"), "pos", "id")
    system = placed.filter("system").select(F.col("conv").alias("c"), F.col("window").alias("w"), "pos", "id")
    every = spans.select("conv", "window")
    fixed = every.join(system, every["conv"].eqNullSafe(system["c"]) & (every["window"] != system["w"])).select("conv", "window", F.lit(0).alias("kind"), "pos", "id")
    return own.unionAll(seen).unionAll(fixed)


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The formatted windows of all conversations."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(F.monotonically_increasing_id().alias("id"), "conv", "turn", "role", _head(F.col("role")).alias("head"), escape(F.col("text")).alias("body"))
    rows = materialize(rows, "turns")
    # Turns that share their number are ordered by what they say; only their texts go along with the sizes.
    ties = rows.groupBy("conv", "turn").agg(F.count("*").alias("n")).filter("n > 1")
    tie = rows.join(ties, rows["conv"].eqNullSafe(ties["conv"]) & rows["turn"].eqNullSafe(ties["turn"])).select("id", F.struct("head", "body").alias("tie"))
    sizes = rows.select("id", "conv", "turn", "role", F.ceil((F.length("head") + F.length("body") + len(END)) / 4).cast("long").alias("size")).join(tie, "id", "left")
    placed = materialize(_placed(sizes, budget, history), "placed")
    said = rows.select("id", "head", "body", (F.col("role") == "assistant").alias("target"))
    every = _copies(placed, budget).join(said, "id").select("conv", "window", F.struct("kind", F.struct("pos", "head", "body", "target").alias("p")).alias("x"))
    built = every.groupBy("conv", "window").agg(F.array_sort(F.collect_list("x")).alias("all"))
    return _write(built).withColumnRenamed("conv", conv_col)


def _write(built: DataFrame) -> DataFrame:
    text = F.transform("all", lambda x: F.concat(x["p"]["head"], x["p"]["body"], F.lit(END)))
    sized = built.select("conv", "window", "all", F.array_join(text, "").alias("text"), F.transform(text, F.length).alias("sizes"), F.size(F.filter("all", lambda x: x["kind"] < 2)).cast("long").alias("n_repeated"))
    # Running ends of the turns by one fold, then the body's span of each own assistant turn.
    ends = F.aggregate("sizes", F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    spans = F.filter(
        F.transform("all", lambda x, i: F.struct((F.get("ends", i) + F.length(x["p"]["head"])).alias("start"), (F.get("ends", i + 1) - len(END)).alias("end"), (x["p"]["target"] & (x["kind"] == 2)).alias("on"))),
        lambda s: s["on"],
    )
    loss = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return sized.withColumn("ends", ends).select("conv", "window", "text", "n_repeated", loss.alias("loss"))


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, turns array of role and text, targets: the unescaped text under the loss mask, formatted_chars) from the windows' texts and masks alone."""
    parts = F.slice(F.split("text", "</turn>\n", -1), (F.col("n_repeated") + 1).cast("int"), F.lit(1 << 30))
    parts = F.filter(parts, lambda p: p != "")
    turn = F.transform(parts, lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(5)), ": ", 1), True).alias("role"), unescape(F.substr(p, F.length(F.substring_index(p, ": ", 1)) + 3)).alias("text")))
    target = F.array_join(F.transform("loss", lambda s: unescape(F.substr("text", s["start"] + 1, s["end"] - s["start"]))), "")
    one = formatted.select(F.col(conv_col).alias("conv"), "window", turn.alias("turns"), target.alias("target"), F.length("text").cast("long").alias("size"))
    return one.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "target"))).alias("w"), F.sum("size").alias("formatted_chars")).select(
        F.col("conv").alias(conv_col), F.flatten(F.col("w.turns")).alias("turns"), F.array_join(F.col("w.target"), "").alias("targets"), "formatted_chars"
    )
