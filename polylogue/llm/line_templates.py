"""Line dedup with a log-template tree of fixed depth.

A line's path in the tree is its number of words and its leading words, with any
word that holds a digit replaced by a wildcard. The lines of a leaf are clustered in
rounds. In a round each position of a cluster keeps the word that most of its lines
have there, or becomes a wildcard; if enough words are left, they are a
template, and the lines that agree with enough of these words share it. The other
lines of the cluster are split by the commonest word at a place that each shares with some but not
all lines, until a line shares no more words: it is then its own template. Lines
whose template recurs in enough documents are dropped; a long line needs fewer
documents, since long passages do not recur by chance. Leaves with fewer lines than their
documents must be hold no recurring template, so nothing moves for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Leading words of a path, share of a cluster's lines that a template's word needs, share of a line's words that
#: a template keeps at least, and share of these words that a line must have.
DEPTH, KEEP, CONSTANT, SIMILAR = 3, 0.5, 0.5, 0.7
#: Documents from which a template recurs, by least number of words.
LIMITS = ((50, 2), (20, 5), (0, 10))
#: Up to so many leaves, those that are looked at are broadcast; beyond, they are joined.
LEAVES = 200_000
WILD = "<*>"

_BLANK = r"[ \t\r]+"


def _limit(words: Column, min_docs: int | None) -> Column:
    if min_docs is not None:
        return F.lit(min_docs)
    out = F.lit(LIMITS[-1][1])
    for least, docs in reversed(LIMITS[:-1]):
        out = F.when(words >= least, docs).otherwise(out)
    return out


def _lines(docs: DataFrame, depth: int) -> DataFrame:
    """(doc_id, h, line_no, masked, size, path) of the lines that are not blank."""
    lines = docs.select("doc_id", "h", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    trimmed = F.btrim("line", F.lit(" \t\r"))
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace(trimmed, r"[^ \t\r0-9]*[0-9][^ \t\r]*", WILD)).otherwise(trimmed)
    lines = lines.select("doc_id", "h", "line_no", masked.alias("masked")).where("masked <> ''").withColumn("words", F.split("masked", _BLANK))
    return lines.select("doc_id", "h", "line_no", "masked", F.size("words").alias("size"), F.concat_ws(" ", F.size("words"), F.slice("words", 1, depth)).alias("path"))


def _votes(lines: DataFrame) -> DataFrame:
    """(cluster, at, word, n): lines of a cluster that have the word at the place."""
    return lines.select("cluster", "n", F.posexplode("words").alias("at", "word")).groupBy("cluster", "at", "word").agg(F.sum("n").alias("n"))


def _clustered(lines: DataFrame, scratch: Scratch, keep: float, constant: float, similar: float, min_docs: int | None) -> DataFrame:
    """(masked, template) of those of the distinct ``lines`` (path, masked, size, n) whose template has lines enough to recur.

    Two clusters share no template: at the place that they part, all lines of one have a word that no line of
    the other has, and a line that agrees with the template of an earlier round has left with it. So a cluster with fewer lines
    than the documents a template must be in holds none that recurs, nor does any that it would be split into.
    """
    rest = scratch.stored(lines.select(F.col("path").alias("cluster"), "masked", "size", "n"), "template-clusters")
    named = []
    plain = F.array_join(F.split("masked", _BLANK), " ").alias("template")
    limit = _limit(F.col("size"), min_docs)
    while True:
        # a line that is alone in its cluster is its own template, and most are: nothing of it is counted
        sizes = rest.groupBy("cluster", "size").agg(F.count("*").alias("lines"), F.sum("n").alias("all"), F.first("masked").alias("masked"))
        sizes = scratch.stored(sizes.where(F.col("all") >= limit), "template-sizes")
        named.append(sizes.where("lines = 1").select("masked", plain))
        several = sizes.where("lines > 1").select("cluster")
        if several.isEmpty():
            break
        rest = rest.join(several, "cluster", "left_semi")
        words = rest.withColumn("words", F.split("masked", _BLANK))
        votes = _votes(words)
        best = votes.groupBy("cluster", "at").agg(F.max(F.struct("n", "word")).alias("best"), F.sum("n").alias("of"))
        word = F.when(F.col("best.n") >= keep * F.col("of"), F.col("best.word")).otherwise(WILD)
        template = (best.select("cluster", "at", word.alias("word"), "of").groupBy("cluster")
                    .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("template"), F.first("of").alias("of")))
        own = words.join(template, "cluster")
        kept = F.size(F.filter("template", lambda t: t != WILD))
        agree = F.size(F.filter(F.zip_with("words", "template", lambda w, t: (w == t) & (t != WILD)), lambda x: x))
        member = (kept >= constant * F.size("words")) & (agree >= similar * kept)
        own = scratch.stored(own.select("cluster", "masked", "size", "n", "words", "of", member.alias("member"), F.array_join("template", " ").alias("template")), "template-lines")
        named.append(own.where("member").select("masked", "template"))
        # lines that no template takes stay without one if they are fewer than a template needs
        enough = own.where("not member").groupBy("cluster", "size", "of").agg(F.sum("n").alias("all")).where(F.col("all") >= limit)
        others = own.where("not member").join(enough.select("cluster"), "cluster", "left_semi")
        # words of several lines of the cluster, but not all; one in too few lines would make a cluster that holds no template
        votes = _votes(own.join(enough.select("cluster"), "cluster", "left_semi")).join(enough.select("cluster", "size", "of"), "cluster")
        shared = votes.where((F.col("word") != WILD) & (F.col("n") >= limit) & (F.col("n") < F.col("of")))
        shared = scratch.stored(shared.select("cluster", "at", "word", F.col("n").alias("votes")), "template-shared")
        # a line is split by the one of these words that most lines have; it is only read at places where its cluster has any
        places = shared.groupBy("cluster").agg(F.collect_set("at").alias("places"))
        left = others.join(places, "cluster").select("cluster", "masked", "n", "words", F.explode("places").alias("at"))
        met = left.select("cluster", "masked", "n", "at", F.get("words", F.col("at")).alias("word")).join(shared, ["cluster", "at", "word"]).where("votes > n")
        picks = met.groupBy("masked").agg(F.max(F.struct("votes", -F.col("at"), "word")).alias("pick"))
        split = others.select("cluster", "masked", "size", "n").join(picks, "masked", "left")
        split = scratch.stored(split.select("masked", "size", "n", F.when(F.col("pick").isNotNull(), F.concat_ws("\x1f", "cluster", -F.col("pick.col2"), "pick.word")).alias("cluster")), "template-split")
        named.append(split.where("cluster is null").select("masked", plain))
        rest = split.where("cluster is not null")
    out = lines.select("masked", F.col("masked").alias("template")).limit(0)
    for part in named:
        out = out.unionByName(part)
    return out


def recurring_lines(docs: DataFrame, depth: int = DEPTH, keep: float = KEEP, constant: float = CONSTANT, similar: float = SIMILAR,
                    min_docs: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, h, line_no, template) of every line of a recurring template; line_no counts from 0, h is a hash of the text.

    ``docs`` has doc_id and text, other columns are ignored. Null texts have no lines,
    blank lines no template. Rows are documents, told apart by id and text; one that is repeated
    counts once. Equally common words are settled by their place and spelling. ``min_docs``
    replaces the limits by length. Lines of any length are read whole.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    lines = _lines(docs, depth)
    leaves = scratch.stored(lines.groupBy("path", "size").agg(F.count("*").alias("n")).where(F.col("n") >= _limit(F.col("size"), min_docs)).select("path"), "template-leaves")
    few = leaves.count() <= LEAVES
    held = scratch.stored(lines.join(F.broadcast(leaves) if few else leaves, "path", "left_semi"), "template-held")
    named = scratch.stored(_clustered(held.groupBy("path", "masked", "size").agg(F.count("*").alias("n")), scratch, keep, constant, similar, min_docs), "template-named")
    found = held.join(named, "masked").select("doc_id", "h", "line_no", "size", "template")
    docs_of = found.select("template", "size", "doc_id", "h").distinct().groupBy("template", "size").agg(F.count("*").alias("docs"))
    recurs = docs_of.where(F.col("docs") >= _limit(F.col("size"), min_docs)).select("template")
    return found.join(recurs, "template", "left_semi").select("doc_id", "h", "line_no", "template")


def without_recurring_lines(docs: DataFrame, **how: float) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every row with the lines of recurring templates taken out.

    Null text counts as empty (one blank line). Rows with equal id and text lose the same lines; rows with
    equal ids and other texts, or with null ids, each lose their own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    found = (recurring_lines(docs, **how).groupBy("doc_id", "h").agg(F.collect_set("line_no").alias("gone"))
             .select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "gone"))
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("gone", i)), "\n")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (docs["h"] == found["_h"]), "left").select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


#: Rounds that the SQL states; what is left after them would be its own template.
SQL_ROUNDS = 12


def _sql_round(k: int) -> str:
    """Round ``k`` over the lines c{k} (cluster, masked, n, words)."""
    return f"""
v{k} AS (SELECT cluster, pos, word, sum(n) AS n FROM (SELECT cluster, n, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM c{k}) GROUP BY ALL),
b{k} AS (SELECT cluster, pos, CASE WHEN max(n) >= {KEEP} * sum(n) THEN arg_max(word, (n, word)) ELSE '{WILD}' END AS word, sum(n) AS total FROM v{k} GROUP BY cluster, pos),
t{k} AS (SELECT cluster, list(word ORDER BY pos) AS template, any_value(total) AS total FROM b{k} GROUP BY cluster),
o{k} AS (SELECT c.*, template, total, len(list_filter(template, lambda x: x <> '{WILD}')) AS kept,
    len(list_filter(list_zip(words, template), lambda x: x[1] = x[2] AND x[2] <> '{WILD}')) AS agree FROM c{k} c JOIN t{k} USING (cluster)),
m{k} AS (SELECT *, kept >= {CONSTANT} * len(words) AND agree >= {SIMILAR} * kept AS member FROM o{k}),
p{k} AS (SELECT l.masked, arg_max({{'pos': l.pos, 'word': l.word}}, (v.n, -l.pos, l.word)) AS pick
  FROM (SELECT cluster, masked, n AS own, total, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM m{k} WHERE NOT member) l
  JOIN v{k} v ON v.cluster = l.cluster AND v.pos = l.pos AND v.word = l.word WHERE l.word <> '{WILD}' AND v.n > own AND v.n < total GROUP BY l.masked),
n{k} AS (SELECT masked, array_to_string(template, ' ') AS template FROM m{k} WHERE member
  UNION ALL SELECT masked, array_to_string(words, ' ') FROM m{k} WHERE NOT member AND masked NOT IN (SELECT masked FROM p{k})),
c{k + 1} AS (SELECT m.cluster || chr(31) || (pick.pos - 1) || chr(31) || pick.word AS cluster, m.masked, m.n, m.words FROM m{k} m JOIN p{k} USING (masked) WHERE NOT member),"""


_LIMIT_SQL = "CASE " + " ".join(f"WHEN {{0}} >= {least} THEN {docs}" for least, docs in LIMITS) + " END"

ORACLE = f"""
WITH l AS (
  SELECT doc_id, text, i - 1 AS line_no, regexp_replace(x, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') AS line
  FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
m AS (SELECT doc_id, text, line_no, regexp_replace(line, '[^ \\t\\r0-9]*[0-9][^ \\t\\r]*', '{WILD}', 'g') AS masked FROM l WHERE line <> ''),
q AS (SELECT *, regexp_split_to_array(masked, '[ \\t\\r]+') AS words FROM m),
c0 AS (SELECT concat_ws(' ', len(words), array_to_string(words[1:{DEPTH}], ' ')) AS cluster, masked, count(*) AS n, words FROM q GROUP BY ALL),
{"".join(_sql_round(k) for k in range(SQL_ROUNDS))}
named AS ({" UNION ALL ".join(f"SELECT * FROM n{k}" for k in range(SQL_ROUNDS))} UNION ALL SELECT masked, array_to_string(words, ' ') FROM c{SQL_ROUNDS}),
s AS (SELECT doc_id, text, line_no, len(words) AS size, template FROM q JOIN named USING (masked)),
recurs AS (SELECT template FROM (SELECT DISTINCT template, size, doc_id, text FROM s) GROUP BY template, size HAVING count(*) >= {_LIMIT_SQL.format("size")}),
gone AS (SELECT DISTINCT doc_id, text, line_no FROM s SEMI JOIN recurs USING (template)),
kept AS (SELECT d.doc_id, d.text, string_agg(x, chr(10) ORDER BY i) FILTER (g.line_no IS NULL) AS left_over, count(*) AS n_lines, count(g.line_no) AS n_dropped
  FROM (SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) d
  LEFT JOIN gone g ON g.doc_id = d.doc_id AND g.text = d.text AND g.line_no = d.i - 1 GROUP BY d.doc_id, d.text)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(left_over, '')) AS text_sha256 FROM kept
"""
