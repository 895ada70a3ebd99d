"""Line dedup: lines that many documents share are dropped from all of them.

Texts are exploded into lines; a line's key is the line without blanks at its ends and with A-Z in lower case, and
travels as a 128-bit hash. A first pass counts the distinct documents of each hash (partial counts before each shuffle)
and writes those at or over the threshold. A second pass explodes lines with their positions, keeps those whose hash is
such a one, and gathers the positions by document; the text is then reassembled from all other positions.

No hash is a hot group in the second pass: hashes with at least one in ``HOT`` of all (document, line) pairs, of which
there are at most ``HOT``, are broadcast; those that are joined by a shuffle are rarer than that. What one task gathers of a
document are the positions of its own lines.

Nulls: a null text is one empty line; documents of a null id count as one document. Repeated rows count as one document and
each give a row. Texts of any length are split whole; a line that a document holds many times counts once. Ties do not occur: a count is
at the threshold or not. Further columns, whatever their names, stay as they are. Empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_DOCUMENTS = 10
MIN_CHARS = 1
#: At most so many hashes are broadcast, 16 bytes each.
HOT = 1 << 16
BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _lowered(line: Column) -> Column:
    """A-Z in lower case; the mapping of single letters is slow and left to lines that have others than ASCII."""
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, _UPPER, _UPPER.lower()))


def keys_of(text: Column) -> Column:
    """The keys of the lines of ``text``, in order."""
    return F.transform(F.transform(lines_of(text), lambda s: F.btrim(s, F.lit(BLANKS))), _lowered)


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def _hashes(text: Column, min_chars: int) -> Column:
    """A hash for each line, null for keys that are too short to be dropped."""
    return F.transform(keys_of(text), lambda k: F.when(F.length(k) >= min_chars, _hash(k)))


def frequent(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS) -> tuple[DataFrame, int]:
    """(a, b, n_documents) of the lines that at least ``min_documents`` documents hold, and how many pairs of a document
    and such a line there are."""
    pairs = common.texts(docs).select(F.struct("doc_id").alias("id"), F.explode_outer(_hashes(F.col("text"), min_chars)).alias("h")).filter("h is not null")
    counted = pairs.groupBy("h").agg(F.count_distinct("id").alias("n_documents")).filter(F.col("n_documents") >= min_documents)
    found = common.stored(counted.select("h.a", "h.b", "n_documents"), "lines")
    return found, found.agg(F.sum("n_documents")).first()[0] or 0


def dropped_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(row, dropped): for each text of which lines are dropped, named as ``common.row_hash`` does, their 1-based positions."""
    found, pairs = frequent(docs, min_documents, min_chars)
    least = max(min_documents, -(-pairs // HOT))  # of hashes in so many documents there are at most HOT
    named = common.texts(docs).select(_row("doc_id", "text").alias("row"), _hashes(F.col("text"), min_chars).alias("hashes"))
    lines = named.select("row", F.posexplode_outer("hashes").alias("i", "h")).filter("h is not null")
    lines = lines.select("row", F.col("i") + 1, "h.a", "h.b").toDF("row", "position", "a", "b")
    hot = F.broadcast(found.filter(F.col("n_documents") >= least).select("a", "b"))
    rest = found.filter(F.col("n_documents") < least).select("a", "b")
    cut = lines.join(hot, ["a", "b"], "left_semi")
    if least > min_documents:
        # only what is not hot is shuffled by its hash
        cut = cut.unionByName(lines.join(hot, ["a", "b"], "left_anti").join(rest, ["a", "b"], "left_semi"))
    return cut.groupBy("row").agg(F.collect_set("position").alias("dropped"))


def _row(doc_id: str, text: str) -> Column:
    """Names a row by its id and text in 128 bits: rows that share a name have equal texts."""
    text, doc_id = F.coalesce(F.col(text), F.lit("")), F.col(doc_id).cast("long")
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit(1), text, doc_id).alias("b"))


def without_common_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``text`` reassembled from the lines that stay, and the numbers of lines before (n_lines) and of lines
    dropped (n_dropped); a clashing column of ``docs`` gives way to an underscored name for the new one."""
    row, positions, lines = (common.unused(docs, c) for c in ("row", "dropped", "lines"))
    n_lines, n_dropped = (common.unused(docs, c) for c in ("n_lines", "n_dropped"))
    cut = dropped_lines(docs, min_documents, min_chars).select(F.col("row").alias(row), F.col("dropped").alias(positions))
    joined = docs.withColumn(row, _row("doc_id", "text")).join(cut, row, "left")
    joined = joined.withColumn(lines, lines_of(F.col("text")))
    stay = F.array_except(F.sequence(F.lit(1), F.size(lines)), F.col(positions))
    kept = F.array_join(F.transform(stay, lambda i: F.element_at(F.col(lines), i)), "\n")
    joined = joined.withColumn(n_lines, F.size(lines).cast("long")).withColumn(n_dropped, F.coalesce(F.size(positions), F.lit(0)).cast("long"))
    return joined.withColumn("text", F.when(F.col(positions).isNull(), F.col("text")).otherwise(kept)).drop(row, positions, lines)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten or more of them share."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = without_common_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS uid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT uid, doc_id, unnest(lines) AS s, generate_subscripts(lines, 1) AS i FROM doc),
keyed AS (
  SELECT uid, doc_id, s, i, translate(trim(s, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT {'id': doc_id}) >= 10),
flagged AS (SELECT uid, doc_id, s, i, f.k IS NOT NULL AS cut FROM keyed LEFT JOIN frequent f ON f.k = keyed.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_dropped,
  sha256(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (WHERE NOT cut), '')) AS kept_sha256
FROM flagged GROUP BY uid, doc_id
"""
