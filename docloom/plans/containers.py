"""Registered queries over archive entries, package XML, macro sheets and shared chains, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.operators import containers
from docloom.plans import views as V
from docloom.plans.catalogue import query
from docloom.plans.trees import _LINES, lines
from docloom.sources import artifacts
from docloom.storage import fresh, stored

_pick = lambda values, i: F.element_at(F.array(*(F.lit(v) for v in values)), (i % len(values) + 1).cast("int"))
_ord = lambda: F.col("l_linenumber").cast("long") * (1 << 32) + F.col("l_partkey") * 4096 + F.col("l_suppkey")
_ORD = "l_linenumber * 4294967296 + l_partkey * 4096 + l_suppkey"

# Archives

NAMES = (
    "word/a.xml", "WORD/a.xml", "word/b.xml", "word/c.xml", "../up.xml", "a/%2E/b", "/root.xml", "C:/x", "a\\b", "word/a.xml", "x/" * 21 + "deep.xml", "word/d.xml", "xl/e.xml", "ppt/f.xml", "g.bin", "h.bin", "i.bin",
)
#: Names that are refused, by hand.
_TRAVERSALS = ("../up.xml", "a/%2E/b", "/root.xml", "C:/x", "a\\b")
V.SQL["entries"] = f"""SELECT l_orderkey AS doc_id, {_ORD} AS ord, list_extract({V._list(NAMES)}, CAST((l_partkey * 3 + l_linenumber) % {len(NAMES)} + 1 AS INT)) AS name, CAST(l_partkey % 29 * 2000000 AS BIGINT) AS size,
    CAST(CASE WHEN l_partkey % 11 = 0 THEN 0 WHEN l_partkey % 7 = 0 THEN l_partkey % 29 * 2000000 // 160 ELSE l_partkey % 29 * 200000 + 1 END AS BIGINT) AS packed FROM {_LINES}"""
_list_of = lambda names: "(" + ", ".join(f"'{V._q(n)}'" for n in names) + ")"
_ENTRIES = f"""+e AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY ord) AS running, row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY ord) AS same, row_number() OVER (PARTITION BY doc_id, name ORDER BY ord) AS exact FROM entries),
c AS (SELECT *, CASE WHEN name IN {_list_of(_TRAVERSALS)} THEN 'path-traversal' WHEN name LIKE '%deep.xml' THEN 'path-too-deep' WHEN size > 52428800 THEN 'file-too-large' WHEN packed > 0 AND size > 100 * packed THEN 'compression-ratio'
    WHEN exact > 1 OR same > 1 THEN 'duplicate-name' WHEN running > 104857600 AND running - size <= 104857600 THEN 'total-size' END AS code FROM e),
m AS (SELECT *, CASE code WHEN 'path-traversal' THEN 'Path traversal: ' || name WHEN 'path-too-deep' THEN 'Path too deep: ' || name || ' (max depth: 20)' WHEN 'file-too-large' THEN 'File too large: ' || name || ' (' || size || ' bytes, max: 52428800 bytes)'
    WHEN 'compression-ratio' THEN 'Suspicious compression ratio for ' || name || ': ' || printf('%.1f', size / CAST(packed AS DOUBLE)) || ':1 (max: 100.0:1)' WHEN 'duplicate-name' THEN CASE WHEN exact > 1 THEN 'Duplicate file name in archive: ' ELSE 'Duplicate file name in archive (case-insensitive): ' END || name END AS message FROM c)
"""


def entries(spark, d) -> DataFrame:
    """(doc_id, ord, name, size, packed): an archive entry for each line of an order."""
    p = F.col("l_partkey").cast("long")
    size = p % 29 * 2_000_000
    packed = F.when(p % 11 == 0, 0).when(p % 7 == 0, F.floor(size / 160)).otherwise(p % 29 * 200_000 + 1)
    return lines(spark, d).select(F.col("l_orderkey").alias("doc_id"), _ord().alias("ord"), _pick(NAMES, p * 3 + F.col("l_linenumber")).alias("name"), size.alias("size"), packed.cast("long").alias("packed"))


@query("archive_entry_errors", V.sql(f"{_ENTRIES} SELECT doc_id, ord, name, size, packed, CAST(running AS BIGINT) AS running, code, message FROM m", "entries"))
def archive_entry_errors(spark, d):
    return containers.archive_errors(entries(spark, d))


@query(
    "refused_archives",
    V.sql(f"""{_ENTRIES}, f AS (SELECT doc_id, min(ord) FILTER (WHERE code IS NOT NULL AND code <> 'total-size') AS pos, CAST(sum(size) AS BIGINT) AS total FROM m GROUP BY doc_id)
        SELECT m.doc_id, m.code, m.message FROM f JOIN m ON m.doc_id = f.doc_id AND m.ord = f.pos
        UNION ALL SELECT doc_id, 'total-size', 'Total uncompressed size too large: ' || total || ' bytes (max: 104857600 bytes)' FROM f WHERE pos IS NULL AND total > 104857600""", "entries"),
)
def refused_archives(spark, d):
    return containers.refused_archives(entries(spark, d))


# Package XML

#: Tag to its (Id, Type, Target, mode, fault), @ for the part's key modulo three; faults and values by hand.
RELATIONSHIPS = {
    '<Relationship Id="rId@" Type="t/image" Target="media/a.png"/>': ("rId@", "t/image", "media/a.png", "Internal", None),
    "<rel:Relationship  Target='https://x.example/?a=1&amp;b=2' TargetMode='EXTERNAL' Type='t/link' Id='h@' />": ("h@", "t/link", "https://x.example/?a=1&b=2", "External", None),
    '<Relationship Id="x@" Type="t" Target="a" TargetMode="Elsewhere"></Relationship>': ("x@", "t", "a", None, "{path} relationship has invalid TargetMode: Elsewhere"),
    '<Relationship Type="t" Target="a"/>': (None, "t", "a", "Internal", "{path} relationship is missing Id"),
    '<Relationship Id="y@" Target="a"/>': ("y@", None, "a", "Internal", "{path} relationship is missing Type"),
    '<Relationship Id="z@" Type="t" TargetMode="internal"/>': ("z@", "t", None, "Internal", "{path} relationship is missing Target"),
    '<Relationship Id="rId@" Type="t/style" Target="a &gt; b"/>': ("rId@", "t/style", "a > b", "Internal", None),
    '<Relationships/><RelationshipX Id="no"/>': None,
}
TYPES = {
    '<Default Extension="XML" ContentType="application/xml"/>': ("Default", "xml", "application/xml", None),
    '<ct:Override PartName="/Word/p@.xml" ContentType="t/part"/>': ("Override", "word/p@.xml", "t/part", None),
    '<Override PartName="word/P@.XML" ContentType="t/other"></Override>': ("Override", "word/p@.xml", "t/other", None),
    '<Default ContentType="application/xml"/>': ("Default", None, "application/xml", "[Content_Types].xml entry is missing Extension"),
    '<Override PartName="/q@.xml"/>': ("Override", "q@.xml", None, "[Content_Types].xml entry is missing ContentType"),
    "<Override ContentType='t'/>": ("Override", None, "t", "[Content_Types].xml entry is missing PartName"),
    "<Defaults/>": None,
}


def _tags(spark, d, tags: dict) -> DataFrame:
    """(doc_id, path, xml): the tags of an order's lines as one file."""
    p = F.col("l_partkey").cast("long")
    tag = F.replace(_pick(tuple(tags), p + F.col("l_linenumber")), F.lit("@"), (p % 3).cast("string"))
    rows = lines(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.struct(_ord().alias("o"), tag.alias("tag")).alias("t"))
    xml = F.concat(F.lit("<Root>"), F.array_join(F.array_sort(F.collect_list("t"))["tag"], "\n"), F.lit("</Root>"))
    return rows.groupBy("doc_id").agg(xml.alias("xml")).select("doc_id", F.concat(F.lit("part"), F.col("doc_id").cast("string"), F.lit(".rels")).alias("path"), "xml")


def _tag_rows(tags: dict, names: str) -> str:
    """The expected rows of the lines' tags that are entries, numbered in their file."""
    value = lambda v: "NULL" if v is None else f"'{V._q(v)}'"
    rows = ", ".join(f"({i}, {', '.join(map(value, v))})" for i, v in enumerate(tags.values()) if v)
    filled = ", ".join(f"replace({n}, '@', CAST(l_partkey % 3 AS VARCHAR)) AS {n}" for n in names.split(", "))
    return f"SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORD}) - 1 AS ord, 'part' || l_orderkey || '.rels' AS path, {filled} FROM {_LINES} JOIN (VALUES {rows}) v(i, {names}) ON CAST((l_partkey + l_linenumber) % {len(tags)} AS INT) = v.i"


_REL = f"+r AS ({_tag_rows(RELATIONSHIPS, 'id, type, target, mode, fault')}), s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY ord) AS again FROM r), t AS (SELECT doc_id, path, ord, id, type, target, mode, coalesce(replace(fault, '{{path}}', path), CASE WHEN again > 1 THEN path || ' contains duplicate relationship Id: ' || id END) AS error FROM s)"


@query("relationship_entries", "WITH " + _REL[1:] + " SELECT * FROM t")
def relationship_entries(spark, d):
    return containers.relationship_entries(_tags(spark, d, RELATIONSHIPS))


@query("refused_relationships", "WITH " + _REL[1:] + " SELECT doc_id, path, arg_min(error, ord) AS error FROM t WHERE error IS NOT NULL GROUP BY ALL")
def refused_relationships(spark, d):
    """The first error of each relationships part that has one."""
    bad = containers.relationship_entries(_tags(spark, d, RELATIONSHIPS)).filter("error is not null")
    return bad.groupBy("doc_id", "path").agg(F.min_by("error", "ord").alias("error"))


@query(
    "content_type_entries",
    f"""WITH r AS ({_tag_rows(TYPES, "kind, key, content_type, fault")}), s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, key ORDER BY ord) AS again FROM r)
    SELECT doc_id, ord, kind, key, content_type, coalesce(fault, CASE WHEN again > 1 THEN '[Content_Types].xml contains duplicate ' || CASE kind WHEN 'Default' THEN 'Default extension: ' ELSE 'Override part: ' END || key END) AS error FROM s""",
)
def content_type_entries(spark, d):
    return containers.content_type_entries(_tags(spark, d, TYPES))


# Macro sheets

#: Formula to its dangerous functions with their arguments, by hand.
CELLS = {
    '=EXEC("calc")': (("EXEC", '"calc"'),), "=SUM(A1)": (), '=CALL("k","l")+RUN(R1C1)': (("CALL", '"k","l"'), ("RUN", "R1C1")), "=MYEXEC(1)": (), "=auto_open()": (), "=exec (A1": (("EXEC", None),), None: (),
}
_SHEET = "CASE WHEN event_type IN ('signup', 'purchase') THEN 'sheet' WHEN event_type IN ('click', 'view') THEN 'cell' ELSE 'name' END"
_PARSED = f"""p AS (SELECT user_id AS doc_id, event_id AS seq, {_SHEET} AS kind, 'S' || event_id % 5 AS name, CASE WHEN event_type = 'signup' OR event_id % 3 = 0 THEN 'MacroSheet' ELSE 'Worksheet' END AS sheet_kind, CASE WHEN event_id % 2 = 0 THEN 'hidden' ELSE 'visible' END AS state,
    'A' || event_id AS cell, CAST(event_id % {len(CELLS)} AS INT) AS i FROM events),
c AS (SELECT s.doc_id, s.name AS sheet, s.seq AS sheet_seq, CASE WHEN s.name <> 'S2' THEN 'xl/macrosheets/' || lower(s.name) || '.xml' END AS path, s.sheet_kind, s.state, c.cell, c.i FROM (
    SELECT *, (max(CASE WHEN kind = 'sheet' THEN seq END) OVER (PARTITION BY doc_id ORDER BY seq)) AS pos FROM p) c JOIN p s ON s.doc_id = c.doc_id AND s.seq = c.pos WHERE c.kind = 'cell' AND s.sheet_kind = 'MacroSheet' AND c.i <> {len(CELLS) - 1}),
f(i, formula) AS (VALUES {", ".join(f"({i}, {V._list([f])[1:-1]})" for i, f in enumerate(CELLS))})"""


def parse_events(spark, d) -> tuple[DataFrame, DataFrame]:
    """The events of each user as those of a parse, and (doc_id, sheet, path) of all sheets but one name."""
    k, kind = F.col("event_id").cast("long"), F.col("event_type")
    rows = V.table(spark, d, "events").select(
        F.col("user_id").alias("doc_id"), k.alias("seq"), F.when(kind.isin("signup", "purchase"), "sheet").when(kind.isin("click", "view"), "cell").otherwise("name").alias("kind"), F.concat(F.lit("S"), (k % 5).cast("string")).alias("name"),
        F.when((kind == "signup") | (k % 3 == 0), "MacroSheet").otherwise("Worksheet").alias("sheet_kind"), F.when(k % 2 == 0, "hidden").otherwise("visible").alias("state"),
        F.concat(F.lit("A"), k.cast("string")).alias("cell"), _pick(tuple(CELLS), k).alias("formula"),
    )
    named = rows.filter("kind = 'sheet' and name <> 'S2'").select("doc_id", F.col("name").alias("sheet")).distinct()
    return rows, named.withColumn("path", F.concat(F.lit("xl/macrosheets/"), F.lower("sheet"), F.lit(".xml")))


@query("macro_sheet_cells", f"WITH {_PARSED} SELECT doc_id, sheet, sheet_seq, path, state, cell, formula FROM c JOIN f USING (i)")
def macro_sheet_cells(spark, d):
    return containers.tracked_cells(*parse_events(spark, d), stored)


@query(
    "macro_sheet_functions",
    f"""WITH {_PARSED}, g(i, function, arguments) AS (VALUES {", ".join(f"({i}, '{name}', {V._list([args])[1:-1]})" for i, found in enumerate(CELLS.values()) for name, args in found)})
    SELECT doc_id, sheet, sheet_seq, path, cell, function, arguments FROM c JOIN g USING (i)""",
)
def macro_sheet_functions(spark, d):
    return containers.tracked_functions(containers.tracked_cells(*parse_events(spark, d), stored))


@query(
    "macro_sheet_totals",
    f"""WITH {_PARSED} SELECT p.doc_id, p.name AS sheet, p.seq AS sheet_seq, p.state, coalesce(n, 0) AS cells, coalesce(opens, false) AS has_auto_open FROM p
    LEFT JOIN (SELECT doc_id, sheet_seq, count(*) AS n, bool_or(formula = '=auto_open()') AS opens FROM c JOIN f USING (i) GROUP BY ALL) t ON t.doc_id = p.doc_id AND t.sheet_seq = p.seq WHERE p.kind = 'sheet' AND p.sheet_kind = 'MacroSheet'""",
)
def macro_sheet_totals(spark, d):
    events, paths = parse_events(spark, d)
    return containers.tracked_sheets(events, containers.tracked_cells(events, paths, stored))


# Shared chains

OWNERS = ("WordDocument", "Pictures/p", "Data/d", "VBA/m", "1Table/t")
_CHAINS = f"""ch AS (SELECT l_orderkey // 3 AS doc_id, list_extract({V._list(OWNERS)}, CAST(l_orderkey % {len(OWNERS)} + 1 AS INT)) || CASE WHEN l_orderkey % {len(OWNERS)} = 0 THEN '' ELSE CAST(l_orderkey AS VARCHAR) END AS path, l_linenumber * 10 AS sector,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS position FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
s AS (SELECT doc_id, sector, list(path ORDER BY path, position) AS owners, list(position ORDER BY path, position) AS places FROM ch GROUP BY ALL HAVING count(*) > 1),
t AS (SELECT doc_id, sector, owners, places[1] AS pos, list_transform(places, lambda p: p - places[1]) AS apart FROM s),
u AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, owners, apart ORDER BY pos, sector) AS island FROM t)"""


def sector_chains(spark, d) -> DataFrame:
    """(doc_id, path, sector, position): three orders are the streams of a container; line numbers are their sectors."""
    k = F.col("l_orderkey").cast("long")
    rows = V.table(spark, d, "lineitem").select(k.alias("k"), F.col("l_linenumber").alias("n")).distinct()
    key = F.when(F.col("k") % len(OWNERS) == 0, "").otherwise(F.col("k").cast("string"))
    place = F.row_number().over(W.partitionBy("k").orderBy("n")) - 1  # few lines an order
    return rows.select(F.floor(F.col("k") / 3).alias("doc_id"), F.concat(_pick(OWNERS, F.col("k")), key).alias("path"), (F.col("n") * 10).alias("sector"), place.alias("position"))


@query(
    "shared_chain_runs",
    f"""WITH {_CHAINS} SELECT doc_id, array_to_string(owners, '|') AS owners, arg_min(sector, pos) AS first, arg_max(sector, pos) AS last, count(*) AS length,
    CASE WHEN count(*) >= 3 OR list_contains(owners, 'WordDocument') OR array_to_string(owners, '|') LIKE '%VBA/%' THEN 'high' ELSE 'medium' END AS severity FROM u GROUP BY doc_id, owners, apart, island HAVING count(*) > 1""",
)
def shared_chain_runs(spark, d):
    return containers.shared_runs(sector_chains(spark, d), stored).withColumn("owners", F.array_join("owners", "|"))


# Payload files


@query("macro_source_files", V.sql("SELECT doc_id, 'vba-source' AS kind, 'project ' || doc_id || '.bas' AS name, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS sha256, strlen(string_agg(line, chr(10) ORDER BY line_no)) AS size FROM macros GROUP BY doc_id", "macros"))
def macro_source_files(spark, d):
    """The source of each project written as a file, and what the manifests say of the files."""
    text = F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "\n")
    found = V.macros(spark, d).groupBy("doc_id").agg(text.cast("binary").alias("payload"))
    rows = found.select("doc_id", F.concat(F.lit("project "), F.col("doc_id").cast("string"), F.lit(".bas")).alias("name"), F.lit("vba-source").alias("kind"), "payload")
    path = fresh(spark, "artifacts")
    artifacts.register(spark)
    rows.write.format("artifacts").mode("append").save(path)
    return artifacts.manifests(spark, path).select("doc_id", "kind", "name", "sha256", "size")
