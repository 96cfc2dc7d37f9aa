"""Chat formatting: quotation linking.

Lines are parsed into nested quote levels by their leading ">" marks. Passages,
the runs of lines of one level, and their lines are normalised and hashed. A quoted
passage is joined, in its conversation, to the latest earlier message whose own
words hold it; a reply's parent is the message that most of its shallowest quotation
with a source comes from, or the message before it if nothing is found. Messages come
out without quotations, with parent, depth and their place in reply order: a message is
followed by its replies, each with all of its own, in order of turns.

The join is as-of: a window over (conversation, hash) in order of turns carries the
last original along, so repeated passages never meet pairwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Range of turns that a window sorts together, and messages of a formatted block.
TURN_BLOCK, BLOCK = 1024, 64
_MARKS = r"^(?:[ \t]*>)+"


def _passages(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, level, run, line_no, body, norm): the lines of messages; a run is a passage."""
    lines = rows.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    marks = F.regexp_extract("line", f"({_MARKS})", 1)
    body = F.regexp_replace("line", _MARKS + "[ \t]?", "")
    norm = F.trim(F.regexp_replace(F.lower(body), r"[\s\p{Punct}]+", " "))
    lines = lines.select("conv_id", "turn", "line_no", F.length(F.translate(marks, " \t", "")).alias("level"), body.alias("body"), norm.alias("norm"))
    own = Window.partitionBy("conv_id", "turn").orderBy("line_no")
    new = F.when(F.col("level") == F.lag("level").over(own), 0).otherwise(1)
    return lines.withColumn("new", new).withColumn("run", F.sum("new").over(own)).drop("new")


def _units(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, level, hash, chars): passages and single lines, hashed."""
    runs = (lines.where("norm <> ''").groupBy("conv_id", "turn", "level", "run")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "norm"))), lambda x: x["norm"]), " ").alias("norm")))
    both = runs.select("conv_id", "turn", "level", "norm").unionByName(lines.where("norm <> ''").select("conv_id", "turn", "level", "norm"))
    return both.select("conv_id", "turn", "level", F.sha2("norm", 256).alias("hash"), F.length("norm").alias("chars")).distinct()


def _before(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, before): the turn before each; long conversations are sorted in blocks of turns."""
    turns = turns.withColumn("block", F.floor(F.col("turn") / TURN_BLOCK))
    inner = Window.partitionBy("conv_id", "block").orderBy("turn")
    lasts = turns.groupBy("conv_id", "block").agg(F.max("turn").alias("last"))
    outer = Window.partitionBy("conv_id").orderBy("block")
    lasts = lasts.select("conv_id", "block", F.lag("last").over(outer).alias("carried"))
    return (turns.withColumn("inner", F.lag("turn").over(inner)).join(lasts, ["conv_id", "block"])
            .select("conv_id", "turn", F.coalesce("inner", "carried").alias("before")))


def _steps(links: DataFrame) -> DataFrame:
    """(conv_id, turn, steps): how many links (conv_id, turn, up) lie above each message, by pointer doubling."""
    climb = stored(links.select("conv_id", "turn", "up", F.col("up").isNotNull().cast("long").alias("steps")), "climb")
    while not climb.where("up is not null").isEmpty():
        over = climb.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("more"))
        further = (climb.where("up is not null").join(over, ["conv_id", "up"], "left")
                   .select("conv_id", "turn", F.col("up2").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
        climb = stored(climb.where("up is null").unionByName(further), "climb")
    return climb.select("conv_id", "turn", "steps")


def _next_sibling(tree: DataFrame) -> DataFrame:
    """(conv_id, turn, sibling): the next reply to the same message; many replies are sorted in blocks of turns."""
    replies = tree.where("parent is not null").select("conv_id", "turn", "parent", F.floor(F.col("turn") / TURN_BLOCK).alias("block"))
    inner = Window.partitionBy("conv_id", "parent", "block").orderBy("turn")
    firsts = replies.groupBy("conv_id", "parent", "block").agg(F.min("turn").alias("first"))
    outer = Window.partitionBy("conv_id", "parent").orderBy("block")
    firsts = firsts.select("conv_id", "parent", "block", F.lead("first").over(outer).alias("carried"))
    return (replies.withColumn("inner", F.lead("turn").over(inner)).join(firsts, ["conv_id", "parent", "block"])
            .select("conv_id", "turn", F.coalesce("inner", "carried").alias("sibling")))


def _places(tree: DataFrame) -> DataFrame:
    """(conv_id, turn, place): the place of each message, from 0, when every message is followed by its replies.

    The message after one is its first reply, or else the next sibling of itself or of the nearest message above that has one,
    which is found by pointer doubling. The place is the number of messages before, counted by doubling along these links.
    """
    child = tree.where("parent is not null").groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").alias("child"))
    after = stored(tree.select("conv_id", "turn", "parent").join(_next_sibling(tree), ["conv_id", "turn"], "left")
                   .select("conv_id", "turn", "sibling", F.when(F.col("sibling").isNull(), F.col("parent")).alias("up")), "after")
    while not after.where("sibling is null and up is not null").isEmpty():
        above = after.select("conv_id", F.col("turn").alias("up"), F.col("sibling").alias("found"), F.col("up").alias("up2"))
        open_ = (after.where("sibling is null and up is not null").join(above, ["conv_id", "up"], "left")
                 .select("conv_id", "turn", F.col("found").alias("sibling"), F.when(F.col("found").isNull(), F.col("up2")).alias("up")))
        after = stored(after.where("sibling is not null or up is null").unionByName(open_), "after")
    following = after.join(child, ["conv_id", "turn"], "left").select("conv_id", F.col("turn").alias("up"), F.coalesce("child", "sibling").alias("turn")).where("turn is not null")
    links = tree.select("conv_id", "turn").join(following, ["conv_id", "turn"], "left")
    return _steps(links).withColumnRenamed("steps", "place")


def quote_threads(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parent_turn, linked, depth, place, quoted_lines, text) of every row of ``rows``.

    ``rows`` has conv_id, turn, role and text; other columns are ignored. linked tells a parent
    found by quotation from the message before. depth counts the replies up to the first
    message; place numbers the messages of a conversation from 0 in reply order. text is the message
    without quoted lines and outer blank space. Null text is empty. Of equally long
    quotations the one from the later message counts. Messages of any length are read whole.
    Rows that repeat a (conv_id, turn) are one message for the links, with their lines
    together, and each is returned. Rows with a null conv_id or turn have no parent, depth 0 and no place.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    placed = rows.where("conv_id is not null and turn is not null")
    quoting = placed.where(F.col("text").rlike(r"(?m)^[ \t]*>")).select("conv_id").distinct()
    # only conversations with a quotation have passages to look up
    units = stored(_units(_passages(placed.join(quoting, "conv_id", "left_semi"))), "passages")
    asof = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    source = F.max(F.when(F.col("level") == 0, F.col("turn"))).over(asof)
    found = (units.withColumn("source", source).where("level > 0 and source is not null")
             .groupBy("conv_id", "turn", "level", "source").agg(F.sum("chars").alias("chars"))
             .groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "chars", "source")).alias("best")).select("conv_id", "turn", "best.source"))
    turns = _before(placed.select("conv_id", "turn").distinct()).join(found, ["conv_id", "turn"], "left")
    tree = stored(turns.select("conv_id", "turn", F.coalesce("source", "before").alias("parent"), F.col("source").isNotNull().alias("linked")), "replies")
    depths = _steps(tree.select("conv_id", "turn", F.col("parent").alias("up"))).withColumnRenamed("steps", "depth")

    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    kept = F.filter(lines, lambda x: ~x.rlike(_MARKS))
    about = tree.join(depths, ["conv_id", "turn"]).join(_places(tree), ["conv_id", "turn"])
    return rows.join(about, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.col("parent").alias("parent_turn"), F.coalesce("linked", F.lit(False)).alias("linked"),
        F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), "place", (F.size(lines) - F.size(kept)).cast("long").alias("quoted_lines"),
        F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "").alias("text"))


def chat_blocks(threads: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, block, chat): the conversations of ``threads`` (from ``quote_threads``) in reply order, ``block`` messages each, with role marks; a parent found by quotation is named."""
    head = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>"), F.when(F.col("linked"), F.concat(F.lit(" re:"), "parent_turn")).otherwise(""))
    message = F.struct("place", F.concat_ws("\n", head, "text", F.lit("<|end|>")).alias("text"))
    return (threads.where("conv_id is not null and turn is not null").groupBy("conv_id", F.floor(F.col("place") / block).alias("block"))
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(message)), lambda x: x["text"]), "\n").alias("chat")))


ORACLE = r"""
WITH RECURSIVE l AS (
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations),
p AS (SELECT *, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[ \t]', '', 'g')) AS level,
    trim(regexp_replace(lower(regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '')), '[\s[:punct:]]+', ' ', 'g')) AS norm FROM l),
q AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY i) AS run FROM p),
u AS (SELECT DISTINCT conv_id, turn, level, norm FROM (
    SELECT conv_id, turn, level, norm FROM q WHERE norm <> ''
    UNION ALL SELECT conv_id, turn, level, string_agg(norm, ' ' ORDER BY i) FROM q WHERE norm <> '' GROUP BY conv_id, turn, level, run)),
f AS (SELECT conv_id, turn, arg_max(source, (-level, chars, source)) AS source FROM (
    SELECT conv_id, turn, level, source, sum(length(norm)) AS chars FROM (
      SELECT a.conv_id, a.turn, a.level, a.norm, max(b.turn) AS source FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.norm = b.norm AND b.level = 0 AND b.turn < a.turn
      WHERE a.level > 0 GROUP BY ALL) GROUP BY ALL) GROUP BY ALL),
t AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
tree AS (SELECT t.conv_id, t.turn, coalesce(source, before) AS parent, source IS NOT NULL AS linked FROM t LEFT JOIN f USING (conv_id, turn)),
walk AS (SELECT conv_id, turn, 0 AS depth, [turn] AS path FROM tree WHERE parent IS NULL
  UNION ALL SELECT tree.conv_id, tree.turn, depth + 1, list_append(path, tree.turn) FROM tree JOIN walk ON tree.conv_id = walk.conv_id AND tree.parent = walk.turn),
ranked AS (SELECT conv_id, turn, depth, row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS place FROM walk)
SELECT c.conv_id, c.turn, c.role, tree.parent AS parent_turn, tree.linked, ranked.depth::BIGINT AS depth, ranked.place::BIGINT AS place,
  len(list_filter(string_split(c.text, chr(10)), lambda x: regexp_matches(x, '^(?:[ \t]*>)+')))::BIGINT AS quoted_lines,
  sha256(regexp_replace(array_to_string(list_filter(string_split(c.text, chr(10)), lambda x: NOT regexp_matches(x, '^(?:[ \t]*>)+')), chr(10)), '^\s+|\s+$', '', 'g')) AS text_sha256
FROM conversations c JOIN tree USING (conv_id, turn) JOIN ranked USING (conv_id, turn)
"""
