"""Quotation linking: from messages with nested quotes to reply-ordered conversations without them.

Lines that begin with ``>`` marks are quotes, nested as deep as they have marks; a run of lines of one depth is
a passage. Passages are normalised (lower case, white space as one space) and hashed; a hash joins to messages
whose own text, or a line of it of ``LINE`` characters or more, has that hash: to the earliest such message of the
same conversation that precedes the quoting one, else to the earliest of all if it precedes it in (conv_id, turn)
order. A message replies to the latest message that its outermost quotes link to. Pointer doubling then gives each
message its root and depth. Everything is DataFrame expressions and joins; no group is ever gathered: originals
are reduced to one row per hash before they are joined, so a common passage costs one row.

Nulls: a null text is an empty one; a message with a null conv_id or turn neither links nor is linked to.
Repeated rows each get a result, and count as one message in the reply order. Texts of any length are parsed whole. Ties: of
several messages that a passage links to, the earliest counts; of several that a message quotes, the latest. Further columns are
not looked at, whatever their names. Empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LINE = 20
_BLANK = r"[ \t\n\r\f]+"


def replies_as_mail(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, text): each turn as a mail that quotes the turn before it, and in it the one before that."""
    own = messages.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    known = own.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    before = known.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("said").alias("p1"))
    before2 = known.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("said").alias("p2"))
    quoted = lambda c, mark: F.concat(F.lit(mark), F.replace(F.col(c), F.lit("\n"), F.lit("\n" + mark)), F.lit("\n"))
    mail = F.concat(
        F.concat(F.lit("On turn "), (F.col("turn") - 1).cast("string"), F.lit(" they wrote:\n")),
        F.coalesce(quoted("p2", ">> "), F.lit("")), quoted("p1", "> "), F.lit("\n"), F.col("text"),
    )
    rows = own.join(before, ["conv_id", "turn"], "left").join(before2, ["conv_id", "turn"], "left")
    return rows.select("conv_id", "turn", F.when(F.col("p1").isNull(), F.col("text")).otherwise(mail).alias("text"))


def key_of(text: Column) -> Column:
    """The hash of a normalised passage; null if nothing is left of it."""
    plain = F.trim(F.regexp_replace(F.lower(text), _BLANK, " "))
    return F.when(plain != "", F.md5(plain.cast("binary")))


def parsed(messages: DataFrame) -> DataFrame:
    """(uid, conv_id, turn, text, passages): a message's own text, and its quoted passages (level, text) in order."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    marks = F.transform(lines, lambda s: F.regexp_extract(s, "^((?:>[ ]?)*)", 1))
    rows = messages.select("conv_id", "turn", lines.alias("lines"), marks.alias("marks"))
    levels = F.transform("marks", lambda m: F.length(F.replace(m, F.lit(" "), F.lit(""))))
    bodies = F.zip_with("lines", "marks", lambda s, m: F.substr(s, F.length(m) + 1))
    rows = rows.withColumn("levels", levels).withColumn("bodies", bodies)
    n = F.size("levels")
    # 1-based first lines of the runs of one level
    first = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at("levels", i) != F.element_at("levels", F.greatest(i - 1, F.lit(1)))))
    rows = rows.withColumn("first", first)
    ends = F.concat(F.slice("first", 2, F.size("first")), F.array(n + 1))
    runs = F.zip_with("first", ends, lambda a, b: F.struct(F.element_at("levels", a).alias("level"), F.slice("bodies", a, b - a).alias("said")))
    rows = rows.withColumn("runs", runs)
    passages = F.transform(F.filter("runs", lambda r: r["level"] > 0), lambda r: F.struct(r["level"].alias("level"), F.array_join(r["said"], "\n").alias("said")))
    own = F.flatten(F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["said"]))
    own = F.when(F.exists("levels", lambda x: x > 0), F.filter(own, lambda s: ~s.rlike("^On .+ wrote:$"))).otherwise(own)
    text = F.regexp_replace(F.array_join(own, "\n"), r"^[ \n]+|[ \n]+$", "")
    return rows.select("conv_id", "turn", text.alias("text"), passages.alias("passages")).withColumn("uid", F.monotonically_increasing_id())


def _pieces(text: str) -> Column:
    """(key, whole) of a text and of its longer lines."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda s: F.length(s) >= LINE)
    parts = F.transform(lines, lambda s: F.struct(key_of(s).alias("key"), F.lit(False).alias("whole")))
    return F.array_distinct(F.concat(F.array(F.struct(key_of(F.col(text)).alias("key"), F.lit(True).alias("whole"))), parts))


def linked(mails: DataFrame) -> DataFrame:
    """(uid, passage, level, target): each quoted passage and the message it quotes, null if unknown."""
    said = mails.select("conv_id", "turn", F.inline(_pieces("text"))).filter("key is not null and conv_id is not null and turn is not null")
    local = common.stored(said.groupBy("key", "conv_id").agg(F.min("turn").alias("l_turn")), "originals")
    spread = common.stored(local.groupBy("key").agg(F.min(F.struct("conv_id", F.col("l_turn").alias("turn"))).alias("g")), "earliest")
    quotes = mails.select("uid", "conv_id", "turn", F.posexplode("passages").alias("passage", "p"))
    quotes = quotes.select("uid", "conv_id", "turn", "passage", F.col("p.level").alias("level"), F.col("p.said").alias("said"))
    pieces = quotes.select("uid", "conv_id", "turn", "passage", "level", F.inline_outer(_pieces("said")))
    found = pieces.join(local, ["key", "conv_id"], "left").join(spread, "key", "left")
    here = F.when(F.col("l_turn") < F.col("turn"), F.struct("conv_id", F.col("l_turn").alias("turn")))
    me = F.struct("conv_id", "turn")
    there = F.when(F.col("g") < me, F.col("g"))
    found = found.withColumn("target", F.coalesce(here, there))
    each = found.groupBy("uid", "passage", "level").agg(F.min(F.when(F.col("whole"), F.col("target"))).alias("whole"), F.min("target").alias("part"))
    return each.select("uid", "passage", "level", F.coalesce("whole", "part").alias("target"))


def replies(mails: DataFrame, links: DataFrame) -> DataFrame:
    """(uid, n_quotes, n_linked, parent) of the messages that quote."""
    outer = F.when(F.col("level") == 1, F.col("target"))
    found = links.groupBy("uid").agg(F.count("*").alias("n_quotes"), F.count("target").alias("n_linked"), F.max(outer).alias("outer"), F.max("target").alias("any"))
    return found.select("uid", "n_quotes", "n_linked", F.coalesce("outer", "any").alias("parent"))


def rooted(graph: DataFrame) -> DataFrame:
    """(id, root, depth) from (id, parent) by pointer doubling: as many rounds as the depth has bits.

    Parents precede their children, so there are no cycles. Only messages whose pointer is not yet at a root are
    joined again. Each round is written, so that both sides of the next join are plain tables whose large keys
    can be split.
    """
    none = F.col("parent").isNull()
    state = graph.select("id", F.coalesce("parent", "id").alias("root"), (~none).cast("int").alias("depth"), none.alias("done"))
    state = common.stored(state, "roots")
    while not state.filter("not done").isEmpty():
        up = state.select(F.col("id").alias("at"), F.col("root").alias("above"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        moved = state.filter("not done").join(up, F.col("root") == F.col("at"))
        moved = moved.select("id", F.col("above").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("done"))
        state = common.stored(state.filter("done").unionByName(moved), "roots")
    return state.drop("done")


def conversations(messages: DataFrame) -> DataFrame:
    """Each message without its quotes, with what it replies to, its root and its depth.

    (root_conv, root_turn, depth, conv_id, turn) sorts each conversation in reply order.
    """
    mails = common.stored(parsed(messages), "mails")
    found = common.stored(replies(mails, linked(mails)), "replies")
    rows = mails.select("uid", "conv_id", "turn", "text").join(found, "uid", "left")
    rows = common.stored(rows, "messages")
    graph = rows.filter("conv_id is not null and turn is not null").groupBy(F.struct("conv_id", "turn").alias("id")).agg(F.max("parent").alias("parent"))
    roots = rooted(graph).withColumnRenamed("root", "top")
    rows = rows.join(roots, F.struct(rows["conv_id"], rows["turn"]) == roots["id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(
        "conv_id", "turn", F.coalesce("top.conv_id", "conv_id").alias("root_conv"), F.coalesce("top.turn", "turn").alias("root_turn"), zero("depth"),
        F.col("parent.conv_id").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"), zero("n_quotes"), zero("n_linked"), "text",
    )


def op8_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, as mails that quote, back to reply-ordered messages without quotes."""
    return conversations(replies_as_mail(common.table(spark, sf_dir, "conversations")))


OP8_SQL = r"""
WITH RECURSIVE own AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
known AS (SELECT conv_id, turn, min(text) AS said FROM own GROUP BY ALL),
mail AS (
  SELECT o.conv_id, o.turn, row_number() OVER () AS uid,
    CASE WHEN a.said IS NULL THEN o.text ELSE 'On turn ' || (o.turn - 1) || ' they wrote:' || chr(10)
      || coalesce('>> ' || replace(b.said, chr(10), chr(10) || '>> ') || chr(10), '')
      || '> ' || replace(a.said, chr(10), chr(10) || '> ') || chr(10) || chr(10) || o.text END AS text
  FROM own o LEFT JOIN known a ON a.conv_id = o.conv_id AND a.turn = o.turn - 1
    LEFT JOIN known b ON b.conv_id = o.conv_id AND b.turn = o.turn - 2),
line AS (
  SELECT uid, conv_id, turn, i, regexp_extract(s, '^((?:>[ ]?)*)', 1) AS mark, s
  FROM (SELECT uid, conv_id, turn, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM mail)),
leveled AS (SELECT uid, conv_id, turn, i, length(replace(mark, ' ', '')) AS level, substr(s, length(mark) + 1) AS body FROM line),
run AS (
  SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY uid ORDER BY i) AS run
  FROM (SELECT *, level IS DISTINCT FROM lag(level) OVER (PARTITION BY uid ORDER BY i) AS new, max(level) OVER (PARTITION BY uid) AS deepest FROM leveled)),
message AS (
  SELECT uid, conv_id, turn, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (
    WHERE level = 0 AND NOT (deepest > 0 AND regexp_matches(body, '^On .+ wrote:$'))), ''), '^[ \n]+|[ \n]+$', '', 'g') AS text
  FROM run GROUP BY ALL),
passage AS (SELECT uid, conv_id, turn, run, level, string_agg(body, chr(10) ORDER BY i) AS said FROM run WHERE level > 0 GROUP BY ALL),
said AS (
  SELECT conv_id, turn, trim(regexp_replace(lower(text), '[ \t\n\r\f]+', ' ', 'g')) AS k FROM message
  UNION SELECT conv_id, turn, trim(regexp_replace(lower(s), '[ \t\n\r\f]+', ' ', 'g'))
  FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS s FROM message) WHERE length(s) >= 20),
local AS (SELECT k, conv_id, min(turn) AS l_turn FROM said WHERE k <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
earliest AS (SELECT k, conv_id AS g_conv, l_turn AS g_turn FROM local QUALIFY row_number() OVER (PARTITION BY k ORDER BY conv_id, l_turn) = 1),
piece AS (
  SELECT uid, conv_id, turn, run, level, true AS whole, trim(regexp_replace(lower(said), '[ \t\n\r\f]+', ' ', 'g')) AS k FROM passage
  UNION SELECT uid, conv_id, turn, run, level, false, trim(regexp_replace(lower(s), '[ \t\n\r\f]+', ' ', 'g'))
  FROM (SELECT uid, conv_id, turn, run, level, unnest(string_split(said, chr(10))) AS s FROM passage) WHERE length(s) >= 20),
target AS (
  SELECT p.uid, p.run, p.level, p.whole,
    CASE WHEN l.l_turn < p.turn THEN {'c': p.conv_id, 't': l.l_turn}
      WHEN g_conv < p.conv_id OR g_conv = p.conv_id AND g_turn < p.turn THEN {'c': g_conv, 't': g_turn} END AS target
  FROM piece p LEFT JOIN local l ON l.k = p.k AND l.conv_id = p.conv_id LEFT JOIN earliest e ON e.k = p.k),
link AS (
  SELECT uid, run, level, coalesce(min(target) FILTER (WHERE whole), min(target)) AS target FROM target GROUP BY uid, run, level),
reply AS (
  SELECT uid, count(*) AS n_quotes, count(target) AS n_linked, coalesce(max(target) FILTER (WHERE level = 1), max(target)) AS parent FROM link GROUP BY uid),
row_of AS (SELECT m.*, r.n_quotes, r.n_linked, r.parent FROM message m LEFT JOIN reply r USING (uid)),
graph AS (SELECT conv_id, turn, max(parent) AS parent FROM row_of WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
tree AS (
  SELECT conv_id, turn, conv_id AS root_conv, turn AS root_turn, 0 AS depth FROM graph WHERE parent IS NULL
  UNION ALL SELECT g.conv_id, g.turn, t.root_conv, t.root_turn, t.depth + 1 FROM graph g JOIN tree t ON g.parent.c = t.conv_id AND g.parent.t = t.turn)
SELECT r.conv_id, r.turn, coalesce(t.root_conv, r.conv_id) AS root_conv, coalesce(t.root_turn, r.turn) AS root_turn, CAST(coalesce(t.depth, 0) AS BIGINT) AS depth,
  r.parent.c AS parent_conv, r.parent.t AS parent_turn, CAST(coalesce(n_quotes, 0) AS BIGINT) AS n_quotes, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, r.text
FROM row_of r LEFT JOIN tree t ON t.conv_id = r.conv_id AND t.turn = r.turn
"""
