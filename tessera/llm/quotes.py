"""Chat formatting by quotation linking.

A line's quote level is the number of ">" that lead it (each may have a space around it). Lines of
one level in a row are a passage. A quoted passage, normalised (lower case, runs of other than letters and
digits as one space), is hashed and joined, within its conversation, to the messages whose own
words hold it: as a whole message, or as a paragraph or a line. A passage of several lines also matches a message
that holds these lines in a row (blank ones aside): they meet on the hash of its first two lines, then all are compared. The latest earlier message that
matches, by turn, is the one replied to (the passage of least quote level first, then the longest);
a message that quotes nothing, or nothing known, replies to the turn before it.

Messages come back in reply order: each before those that reply to it, replies in order of turn,
a reply's own replies before the next. That order is the Euler tour of the reply tree, as a linked
list of places where a message is entered and left; positions and depths are suffix sums over it, found
by pointer doubling. A round is a join on keys that are unique, so a conversation of any size, or a
chain of replies of any depth, costs rows in proportion and rounds in its logarithm.

All of it is DataFrame functions; joins are on (conversation, hash), so that a common line or first
turn of many conversations meets only its own conversation.

Defined results: null text is empty; an empty text stays as an empty message; a message of quotes
alone has empty text; rows with null conversation or turn are returned as roots of depth 0; repeated rows are
returned once each, and follow one another; messages of one turn are in order of a hash of their text and role; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import drop_written, written

QUOTE = r"^\x20?(>\x20?)+"
ROUNDS = 40


def level(line: Column) -> Column:
    """How many quote marks lead a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), r"[^>]", ""))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def lines_of(text: Column) -> Column:
    """array<struct<level, text>> of a message's lines, quote marks stripped."""
    return F.transform(F.split(text, "\r?\n"), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, QUOTE, "").alias("text")))


def own_text(lines: Column) -> Column:
    """A message without its quoted lines, outer blank lines trimmed."""
    kept = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["text"]), "\n")
    return F.regexp_replace(kept, r"^(\x20*\n)+|(\n\x20*)+$", "")


def passages(lines: Column) -> Column:
    """array<struct<level, text>>: neighbouring lines of one quote level, joined, quoted ones only."""
    none = F.array().cast("array<struct<level:int,text:string>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        more = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["level"] == x["level"])
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(x["level"].alias("level"), F.concat_ws("\n", last["text"], x["text"]).alias("text"))))
        return F.when(more, grown).otherwise(F.concat(acc, F.array(F.struct(x["level"].alias("level"), x["text"].alias("text")))))

    joined = F.aggregate(lines, none, step)
    return F.filter(joined, lambda x: x["level"] > 0)


def line_hashes(text: Column) -> Column:
    """Hashes of a text's normalised lines, blank ones left out."""
    return F.transform(F.filter(F.transform(F.split(text, "\n"), normalised), lambda x: x != ""), lambda x: F.xxhash64(x))


def runs(rows: DataFrame, quoted: DataFrame) -> DataFrame:
    """(row, level, size, parent, at): messages that hold the lines of a quoted passage of several lines in a row."""
    asked = quoted.where(F.size("lines") >= 2).select("row", "conv_id", "turn", "level", F.length("n").alias("size"), F.col("lines").alias("wanted"), F.xxhash64(F.get("lines", F.lit(0)), F.get("lines", F.lit(1))).alias("h"))
    own = rows.join(asked.select("conv_id").distinct(), "conv_id", "left_semi").select(F.col("row").alias("parent"), "conv_id", F.col("turn").alias("at"), "tie", line_hashes(F.col("own")).alias("said"))
    pairs = F.when(F.size("said") >= 2, F.transform(F.sequence(F.lit(1), F.size("said") - 1), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.get("said", i - 1), F.get("said", i)).alias("h"))))
    held = own.select("parent", "conv_id", "at", "tie", F.explode(pairs).alias("x")).select("parent", "conv_id", "at", "tie", "x.*")
    met = asked.join(held, ["conv_id", "h"]).where("at < turn").join(own.select("parent", "said"), "parent")
    return met.where(F.slice("said", F.col("pos"), F.size("wanted")) == F.col("wanted")).select("row", "level", "size", "parent", "at", "tie")


def parents(rows: DataFrame) -> DataFrame:
    """(row, parent): the earlier row of the conversation that each row replies to; null for first turns.

    rows: row, conv_id, turn, tie, lines, own.
    """
    quoted = rows.where(F.exists("lines", lambda x: x["level"] > 0)).select("row", "conv_id", "turn", F.explode(passages(F.col("lines"))).alias("p"))
    quoted = quoted.select("row", "conv_id", "turn", F.col("p.level").alias("level"), normalised(F.col("p.text")).alias("n"), line_hashes(F.col("p.text")).alias("lines"))
    quoted = quoted.where("n <> ''")
    pieces = F.array_distinct(F.concat(F.array("own"), F.split("own", r"\n\x20*\n"), F.split("own", "\n")))
    # only conversations that quote have their messages hashed
    some = quoted.select("conv_id").distinct()
    held = rows.join(some, "conv_id", "left_semi").select(F.col("row").alias("parent"), "conv_id", F.col("turn").alias("at"), "tie", F.explode(pieces).alias("piece"))
    held = held.select("parent", "conv_id", "at", "tie", F.xxhash64(normalised(F.col("piece"))).alias("h")).distinct()
    asked = quoted.select("row", "conv_id", "turn", "level", F.length("n").alias("size"), F.xxhash64("n").alias("h"))
    met = asked.join(held, ["conv_id", "h"]).where("at < turn").select("row", "level", "size", "parent", "at", "tie").union(runs(rows, quoted))
    linked = met.groupBy("row").agg(F.max(F.struct((-F.col("level")).alias("near"), "size", "at", "tie", (-F.col("parent")).alias("p"))).alias("best"))
    linked = linked.select(F.col("row").alias("r"), (-F.col("best.p")).alias("linked"))
    turns = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min(F.struct("tie", "row")).alias("f")).select("conv_id", "turn", F.col("f.row").alias("first"))
    before = turns.select("conv_id", "turn", F.lag("first").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"))
    out = rows.select("row", "conv_id", "turn", "tie").join(before, ["conv_id", "turn"], "left").join(linked, F.col("row") == F.col("r"), "left")
    return out.select("row", "conv_id", "turn", "tie", F.coalesce("linked", "before").alias("parent"), F.col("linked").isNotNull().alias("quoted"))


def ranked(tree: DataFrame) -> DataFrame:
    """(row, after, depth): how many messages of the list come at or after row, and how deep it lies.

    tree: row, conv_id, turn, tie, parent. Rows without a parent follow one another in their conversation.
    """
    alone = F.col("conv_id").isNull() | F.col("turn").isNull()
    group = F.coalesce(F.concat(F.lit("m"), F.col("parent")), F.when(alone, F.concat(F.lit("r"), F.col("row"))), F.concat(F.lit("c"), F.col("conv_id")))
    order = Window.partitionBy("group").orderBy("turn", "tie", "row")
    sides = tree.withColumn("group", group).withColumn("beside", F.lead("row").over(order))
    below = tree.where("parent IS NOT NULL").groupBy("parent").agg(F.min(F.struct("turn", "tie", "row")).alias("child")).select(F.col("parent").alias("p"), F.col("child.row").alias("child"))
    sides = sides.join(below, F.col("row") == F.col("p"), "left")
    enter = sides.select((F.col("row") * 2).alias("node"), F.coalesce(F.col("child") * 2, F.col("row") * 2 + 1).alias("next"), F.lit(1).cast("long").alias("after"), F.lit(1).cast("long").alias("open"))
    leave = sides.select((F.col("row") * 2 + 1).alias("node"), F.coalesce(F.col("beside") * 2, F.col("parent") * 2 + 1).alias("next"), F.lit(0).cast("long").alias("after"), F.lit(-1).cast("long").alias("open"))
    now = written(enter.union(leave), "tour")
    for _ in range(ROUNDS):
        if now.where("next IS NOT NULL").isEmpty():
            break
        ahead = now.select(F.col("node").alias("n"), F.col("next").alias("next2"), F.col("after").alias("after2"), F.col("open").alias("open2"))
        going = now.where("next IS NOT NULL").join(ahead, F.col("next") == F.col("n"))
        going = going.select("node", F.col("next2").alias("next"), (F.col("after") + F.col("after2")).alias("after"), (F.col("open") + F.col("open2")).alias("open"))
        last, now = now, written(now.where("next IS NULL").union(going), "tour")
        drop_written(last)
    return now.where("node % 2 = 0").select((F.col("node") / 2).cast("long").alias("row"), "after", (-F.col("open")).alias("depth"))


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> DataFrame:
    """conv_id, turn, role, text (without quotes), parent_turn, quoted, depth, position (reply order in its conversation)."""
    lines = lines_of(F.coalesce(F.col(text_col), F.lit("")))
    rows = messages.select(F.monotonically_increasing_id().alias("row"), F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(role_col)).alias("tie"), lines.alias("lines"))
    rows = written(rows.withColumn("own", own_text(F.col("lines"))), "messages")
    tree = written(parents(rows), "parents")
    places = ranked(tree.select("row", "conv_id", "turn", "tie", "parent"))
    longest = F.count(F.when(F.col("turn").isNotNull(), 1))
    sizes = rows.groupBy("conv_id").agg(longest.alias("n")).select(F.col("conv_id").alias("c"), "n")
    said = rows.select(F.col("row").alias("parent"), F.col("turn").alias("parent_turn"))
    out = rows.select("row", "role", F.col("own").alias("text")).join(tree, "row").join(places, "row").join(said, "parent", "left").join(sizes, F.col("conv_id") == F.col("c"), "left")
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    return out.select("conv_id", "turn", "role", "text", "parent_turn", "quoted", "depth", F.when(placed, F.col("n") - F.col("after")).otherwise(0).alias("position"))
