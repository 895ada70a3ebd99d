"""Secret scans with multipart credential linking.

Base finds are regular expressions over whole texts. Beside them each text yields weak parts: possible
secrets (long mixed tokens), possible identifiers (``client_id = ...``) and endpoints (URLs). Parts are
rows (uid, role, start, end); an interval join on (uid, window) finds the parts within ``SCOPE`` code
points of each weak one, as every part is in all windows that it reaches into, and a weak part is reported
only if its complement is there: a secret needs an identifier, an identifier a secret, an endpoint both.
Rows with a weak part meet a bounded number of others, as one window holds few parts.

Nulls: a null text is an empty one without finds, a null id stays null. Repeated rows are scanned each on
its own. Texts of any length are scanned whole. Further columns are not looked at, whatever their names. Offsets are
code points, the end exclusive. Empty input gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

SCOPE = 400
#: In the order in which kinds with equal starts are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "weak_secret", "weak_id", "endpoint")
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "weak_secret": "secret", "weak_id": "id", "endpoint": "endpoint"}
BASE = 3

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WEAK_SECRET = re.compile(r"[A-Za-z0-9+/=_-]{32,}")
WEAK_ID = re.compile(r"""(?:client_id|access_key_id|account_id|user_id|username)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
ENDPOINT = re.compile(r"""(?:https?|postgres|mysql|mongodb|redis|amqp)://[^\s"'<>]{4,}""")

_HEX_RUNS = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_LONG_RUNS = bytes(120 if re.match(r"[A-Za-z0-9+/=_-]", chr(b)) else 32 for b in range(256))


def _union(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that ``spans`` cover, in order."""
    starts, ends = [], []
    for start, end in sorted(spans):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def find(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base finds and weak parts of a UTF-8 text, sorted.

    Substring tests on the bytes rule out most texts before any expression runs.
    """
    low = data.lower()
    assign = b"passw" in low or b"secret" in low or b"token" in low or b"api" in low
    access, hexes = b"AKIA" in data, b"x" * 24 in data.translate(_HEX_RUNS)
    weak, ident, url = b"x" * 32 in data.translate(_LONG_RUNS), b"_id" in low or b"username" in low, b"://" in data
    if not (assign or access or hexes or weak or ident or url):
        return []
    text, found = data.decode("utf-8", "replace"), []
    if assign:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if access:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if hexes:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if weak:
        starts, ends = _union((s, e) for s, _, e in found)
        for m in WEAK_SECRET.finditer(text):
            mixed = re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]) and re.search("[0-9]", m[0])
            i = bisect_left(starts, m.end())  # the last stretch that begins before the token's end
            if mixed and not (i and ends[i - 1] > m.start()):
                found.append((m.start(), 3, m.end()))
    if ident:
        found += [(m.start(), 4, m.end()) for m in WEAK_ID.finditer(text)]
    if url:
        found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    return sorted(found)


_PARTS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
PARTS = "array<struct<start:long,kind:int,end:long>>"


def _parts(texts: list[bytes]) -> pa.Array:
    return pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in find(x)] for x in texts], _PARTS)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, doc_id, text_hash, parts): each row's finds, stored. uid names the row, not the document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), _parts(common.as_bytes(batch, "text"))], ["doc_id", "text_hash", "parts"])

    rows = common.texts(docs, doc_id, text).withColumn("text_hash", F.xxhash64("text"))
    found = rows.mapInArrow(each, f"doc_id long, text_hash long, parts {PARTS}")
    return common.stored(found.withColumn("uid", F.monotonically_increasing_id()), "secrets")


def linked(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(uid, weak): the weak parts of each row that have their complement within ``scope`` code points."""
    role = F.element_at(F.array(*(F.lit(ROLES[k]) for k in KINDS)), F.col("kind") + 1)
    parts = scanned.select("uid", F.inline("parts")).withColumn("role", role)
    weak = parts.filter(F.col("kind") >= BASE).select("uid", "start", "kind", "end", F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))).alias("window"))
    near = parts.select("uid", F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("role").alias("o_role"), F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("window"))
    pairs = weak.join(near, ["uid", "window"]).filter((F.col("o_start") <= F.col("end") + scope) & (F.col("start") <= F.col("o_end") + scope))
    has = pairs.groupBy("uid", "start", "kind", "end").agg(F.bool_or(F.col("o_role") == "id").alias("has_id"), F.bool_or(F.col("o_role") == "secret").alias("has_secret"))
    kept = has.filter(
        ((F.col("kind") == KINDS.index("weak_secret")) & F.col("has_id"))
        | ((F.col("kind") == KINDS.index("weak_id")) & F.col("has_secret"))
        | ((F.col("kind") == KINDS.index("endpoint")) & F.col("has_id") & F.col("has_secret"))
    )
    return kept.groupBy("uid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("weak"))  # of one text, in disjoint spans by kind


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_hash, base, all): arrays of (start, kind, end), sorted, one row per row of ``docs``."""
    scanned = scan(docs, doc_id, text)
    base = F.filter("parts", lambda p: p["kind"] < BASE)
    rows = scanned.select("uid", "doc_id", "text_hash", base.alias("base")).join(linked(scanned, scope), "uid", "left")
    return rows.select("doc_id", "text_hash", "base", F.array_sort(F.concat("base", F.coalesce("weak", F.array().cast(PARTS)))).alias("all"))


def joined(column: str):
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(common.table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("all").alias("spans"))


def masked(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """``text`` with each run of overlapping spans, given in the order of their starts, replaced by ``mark``."""
    out, at, end = [], 0, -1
    for s, e in spans:
        if s >= end:
            out += [text[at:s], mark]
        at = end = max(end, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs`` (columns of documents) with every found span replaced by ``mark``; n_chars follows the text.

    Rows without a find keep their text, nulls included. Overlapping spans count as one. Rows are stored with their
    parts; only those with a weak part, which may or may not stay, meet the links by a shuffle.
    """
    parts, uid, weak = (common.unused(docs, name) for name in ("parts", "uid", "weak"))
    at, lengths = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    schema = docs.schema

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns, _parts(common.as_bytes(batch, "text"))], [*batch.schema.names, parts])

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            columns, spans = list(batch.columns), batch.column(batch.num_columns - 1).to_pylist()
            texts, n = columns[at].to_pylist(), columns[lengths].to_pylist() if lengths is not None else []
            for i, own in enumerate(spans):
                if own:
                    texts[i] = masked(texts[i], [(x["start"], x["end"]) for x in own], mark)
                    if n:
                        n[i] = len(texts[i])
            columns[at] = pa.array(texts, columns[at].type)
            if lengths is not None:
                columns[lengths] = pa.array(n, columns[lengths].type)
            yield pa.RecordBatch.from_arrays(columns[:-1], batch.schema.names[:-1])

    wide = StructType([*schema.fields, *StructType.fromDDL(f"`{parts}` {PARTS}").fields])
    rows = common.stored(docs.mapInArrow(scanned, wide).withColumn(uid, F.monotonically_increasing_id()), "secrets")
    base, doubtful = F.filter(parts, lambda p: p["kind"] < BASE), F.exists(parts, lambda p: p["kind"] >= BASE)
    links = linked(rows.filter(doubtful).select(F.col(uid).alias("uid"), F.col(parts).alias("parts")), scope)
    links = links.select(F.col("uid").alias(uid), F.col("weak").alias(weak))
    sure = rows.filter(~doubtful).drop(uid)
    asked = rows.filter(doubtful).join(links, uid, "left").withColumn(parts, F.array_sort(F.concat(base, F.coalesce(weak, F.array().cast(PARTS))))).drop(uid, weak)
    return sure.unionByName(asked).mapInArrow(mask, schema)
