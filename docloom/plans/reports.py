"""Registered queries over parts, objects, sheets, directories and sectors, and their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.operators import coverage, directory, objects, records, sectors, summaries, trees
from docloom.operators.ranks import ranked
from docloom.plans import views as V
from docloom.plans.catalogue import query, reachable_slots
from docloom.storage import stored

_REMOTE = r"regexp_matches(lower(target), '^((https?|ftp|smb|sftp|ldaps?|file)://|\\\\|//)')"
_EXTERNAL = r"regexp_matches(target, '^(//|\\\\|[A-Za-z][A-Za-z0-9+.-]*:)')"
_WHERE = "coalesce(path, name)"
_ACTIVEX = "(class_id IS NOT NULL OR contains(lower(coalesce(path, name, '')), 'activex') OR ends_with(lower(coalesce(path, name, '')), '.ocx'))"

# Objects


@query("object_rule_findings", V.sql(V.OBJECT_RULES + V.LINK_BURST, "objects"))
def object_rule_findings(spark, d):
    rows = V.objects(spark, d)
    return objects.rule_findings(rows).unionByName(objects.bursts(rows, 2, 2, 1))


@query(
    "format_indicators",
    V.sql(f"""+f(doc_id, indicator, severity, description, location, node_id) AS (
        SELECT doc_id, CASE WHEN {_ACTIVEX} THEN 'ActiveXControl' ELSE 'OleObject' END, 'High', CASE WHEN {_ACTIVEX} THEN 'ActiveX control binary' ELSE 'OLE object' END || ' found' || coalesce(' at ' || {_WHERE}, ''), {_WHERE}, node_id FROM objects WHERE format = 'docx' AND node_type = 'OleObject'
        UNION ALL SELECT doc_id, 'ActiveXControl', 'High', 'ActiveX control found' || coalesce(' at ' || path, ''), path, node_id FROM objects WHERE format = 'docx' AND node_type = 'ActiveXControl'
        UNION ALL SELECT doc_id, 'RemoteResource', 'Medium', 'Remote resource: ' || target, path, NULL FROM objects WHERE format <> 'docx' AND node_type = 'ExternalReference' AND {_REMOTE}
        UNION ALL SELECT doc_id, 'OleObject', 'High', 'Embedded OLE object', CASE format WHEN 'hwp' THEN {_WHERE} WHEN 'rtf' THEN 'rtf' END, CASE WHEN format <> 'odt' THEN node_id END FROM objects WHERE format <> 'docx' AND node_type = 'OleObject')
        SELECT * FROM f""", "objects"),
)
def format_indicators(spark, d):
    return objects.format_indicators(V.objects(spark, d))


@query(
    "analyzer_object_findings",
    V.sql(f"""SELECT * FROM (SELECT doc_id, node_id, node_type AS kind, CASE WHEN node_type = 'OleObject' THEN CASE WHEN linked THEN 'High' ELSE 'Medium' END WHEN node_type = 'ActiveXControl' THEN 'High' WHEN node_type = 'ExternalReference' THEN
        CASE WHEN ref_type IN ('AttachedTemplate', 'OleLink') THEN 'High' WHEN ref_type = 'Hyperlink' AND regexp_matches(lower(target), '^(file://|\\\\\\\\)') THEN 'Medium' WHEN ref_type = 'Hyperlink' AND {_REMOTE} THEN 'Low' WHEN ref_type = 'Image' AND {_REMOTE} THEN 'Medium' END END AS severity FROM objects) WHERE severity IS NOT NULL""", "objects"),
)
def analyzer_object_findings(spark, d):
    return objects.analyzer_findings(V.objects(spark, d))


@query(
    "object_threat_levels",
    V.sql("""SELECT *, ole + activex + refs > 0 AS has_content, CASE WHEN ole + activex > 0 THEN 'High' WHEN refs > 0 THEN 'Medium' ELSE 'None' END AS threat_level FROM (
        SELECT doc_id, count(*) FILTER (WHERE node_type = 'OleObject') AS ole, count(*) FILTER (WHERE node_type = 'ActiveXControl') AS activex, count(*) FILTER (WHERE node_type = 'ExternalReference') AS refs FROM objects GROUP BY doc_id)""", "objects"),
)
def object_threat_levels(spark, d):
    return objects.threat_levels(V.objects(spark, d))


@query(
    "object_scorecard",
    V.sql(f"""+e AS (SELECT doc_id, unnest(['ole-objects', 'activex', 'external-references', 'native-payloads', 'suspicious-relationships']) AS key, unnest(['High', 'High', 'Medium', 'High', 'Medium']) AS r,
          unnest([CASE WHEN node_type = 'OleObject' THEN coalesce({_WHERE}, CAST(node_id AS VARCHAR)) END, CASE WHEN node_type = 'ActiveXControl' THEN coalesce(path, name, prog_id, CAST(node_id AS VARCHAR)) END,
            CASE WHEN node_type = 'ExternalReference' THEN ref_type || ': ' || target END, CASE WHEN node_type = 'OleObject' AND regexp_matches(path, '(Ole10Native|Package)$') THEN {_WHERE} END,
            CASE WHEN format <> 'docx' AND node_type = 'ExternalReference' AND {_REMOTE} THEN coalesce(path || ': ', '') || 'Remote resource: ' || target END]) AS e FROM objects)
        SELECT doc_id, key, CASE WHEN count(e) > 0 THEN CAST(count(e) AS VARCHAR) ELSE 'absent' END AS value, CASE WHEN count(e) > 0 THEN r ELSE 'None' END AS risk, coalesce(string_agg(e, '; ' ORDER BY e), '') AS evidence FROM e GROUP BY doc_id, key, r""", "objects"),
)
def object_scorecard(spark, d):
    return objects.scorecard(V.objects(spark, d))


@query(
    "object_inventory",
    V.sql("""SELECT doc_id, CASE format WHEN 'docx' THEN 'zip-ooxml' WHEN 'odt' THEN 'zip-odf' WHEN 'hwp' THEN 'cfb-ole' ELSE 'rtf' END AS container, node_type AS kind,
        CASE node_type WHEN 'OleObject' THEN 'ole-object' WHEN 'ActiveXControl' THEN 'active-content' ELSE 'relationship-target' END AS export_kind, count(*) AS n FROM objects WHERE node_type IN ('OleObject', 'ActiveXControl', 'ExternalReference') GROUP BY ALL""", "objects"),
)
def object_inventory(spark, d):
    return objects.inventory(V.objects(spark, d))


@query("activex_dedup", V.sql(f"SELECT doc_id, node_id FROM objects o WHERE node_type = 'ActiveXControl' AND NOT EXISTS (SELECT 1 FROM objects x WHERE x.doc_id = o.doc_id AND x.node_type = 'OleObject' AND x.path = o.path AND {_ACTIVEX.replace('class_id', 'x.class_id').replace('path,', 'x.path,').replace('name,', 'x.name,')})", "objects"))
def activex_dedup(spark, d):
    """Controls without those whose part an OLE object reports already."""
    rows = V.objects(spark, d)
    reported = rows.filter((F.col("node_type") == "OleObject") & objects.is_activex_ole()).select("doc_id", "path")
    return rows.filter("node_type = 'ActiveXControl'").join(reported, ["doc_id", "path"], "left_anti").select("doc_id", "node_id")


_AUTO = """+own AS (SELECT * FROM defined_names WHERE upper(name) IN ('_XLNM.AUTO_OPEN', 'AUTO_OPEN', 'AUTO.OPEN')),
m AS (SELECT s.*, EXISTS (SELECT 1 FROM own o WHERE o.doc_id = s.doc_id AND upper(o.target) = upper(s.sheet)) AS named, EXISTS (SELECT 1 FROM own o WHERE o.doc_id = s.doc_id) AS has_name,
  EXISTS (SELECT 1 FROM own o WHERE o.doc_id = s.doc_id AND o.target IS NULL) AS unresolved FROM sheets s),
w AS (SELECT *, bool_or(named) OVER (PARTITION BY doc_id) AS any_named, min(node_id) OVER (PARTITION BY doc_id) AS f FROM m)
"""
_FIRST = "named OR (unresolved AND NOT any_named AND node_id = f)"


@query("xlm_auto_open", V.sql(f"{_AUTO} SELECT doc_id, node_id, sheet, {_FIRST} AS auto_open FROM w", "sheets", "defined_names"))
def xlm_auto_open(spark, d):
    return objects.auto_open(V.sheets(spark, d), V.defined_names(spark, d)).select("doc_id", "node_id", "sheet", "auto_open")


@query("xlm_auto_open_at_parse", V.sql(f"{_AUTO} SELECT doc_id, node_id, sheet, named OR (has_name AND NOT any_named) AS auto_open FROM w", "sheets", "defined_names"))
def xlm_auto_open_at_parse(spark, d):
    return objects.auto_open(V.sheets(spark, d), V.defined_names(spark, d), True).select("doc_id", "node_id", "sheet", "auto_open")


@query(
    "xlm_indicators",
    V.sql(f"""{_AUTO} SELECT doc_id, path AS location, 'Critical' AS severity, 'XLM Auto_Open macro detected' AS description FROM w WHERE {_FIRST}
        UNION ALL SELECT doc_id, path, 'High', 'Hidden macro sheet: ' || sheet FROM w WHERE hidden AND cells > 0 UNION ALL SELECT doc_id, path, 'Critical', 'XLM macro function ' || function || ' at A1' FROM w WHERE function IS NOT NULL""", "sheets", "defined_names"),
)
def xlm_indicators(spark, d):
    return objects.xlm_indicators(objects.auto_open(V.sheets(spark, d), V.defined_names(spark, d)))


@query(
    "extract_links_dde",
    V.sql(r"""+p AS (SELECT doc_id, formula, upper(regexp_extract(formula, '(?i)^\s*(DDEAUTO|DDE)(\s|$)', 1)) AS kind, list_transform(regexp_extract_all(formula, '"((?:[^"]|"")*)(?:"|$)', 1), lambda x: replace(x, '""', '"')) AS parts FROM formulas)
        SELECT doc_id, kind || ' app=' || CASE WHEN coalesce(parts[1], '') = '' THEN 'unknown' ELSE parts[1] END || ' topic=' || CASE WHEN coalesce(parts[1], '') = '' OR coalesce(parts[2], '') = '' THEN '<none>' ELSE parts[2] END
          || ' item=' || CASE WHEN coalesce(parts[1], '') = '' OR coalesce(parts[3], '') = '' THEN '<none>' ELSE parts[3] END AS normalized FROM p WHERE kind <> ''""", "formulas"),
)
def extract_links_dde(spark, d):
    parts = S.dde(F.col("formula"))
    return V.formulas(spark, d).filter(parts[0] != "").select("doc_id", S.normalized_dde(*parts).alias("normalized"))


# Paths and payloads

_EXT = "lower(regexp_extract(path, '[^.]*$'))"


@query(
    "part_media_types",
    V.sql(f"SELECT doc_id, ord, path, CASE WHEN {_EXT} IN ('jpg', 'jpeg', 'png', 'gif', 'bmp', 'tif', 'tiff', 'webp') THEN 'Image' WHEN {_EXT} IN ('mp3', 'wav', 'm4a', 'aac', 'ogg') THEN 'Audio' WHEN {_EXT} IN ('mp4', 'mov', 'avi', 'mkv', 'webm') THEN 'Video' ELSE 'Other' END AS media_type, regexp_extract(path, '[^/]*$') AS file_name, split_part(path, '/', 1) AS root FROM parts", "parts"),
)
def part_media_types(spark, d):
    path = F.col("path")
    return V.parts(spark, d).select("doc_id", "ord", "path", S.media_type(path).alias("media_type"), S.file_name(path).alias("file_name"), S.logical_root(path).alias("root"))


@query(
    "cfb_entry_classes",
    V.sql("""SELECT c AS class, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, CASE WHEN entry_type = 'storage' THEN CASE WHEN u = 'OBJECTPOOL' OR u LIKE 'OBJECTPOOL/%' THEN 'embedded-object-storage' WHEN u = 'VBA' OR u LIKE '%/VBA' THEN 'vba-storage' ELSE 'storage' END
        WHEN u = 'WORDDOCUMENT' THEN 'word-main-stream' WHEN u IN ('WORKBOOK', 'BOOK') THEN 'excel-main-stream' WHEN u = 'POWERPOINT DOCUMENT' THEN 'powerpoint-main-stream' WHEN u = 'PROJECT' OR u LIKE '%/PROJECT' THEN 'vba-project-metadata'
        WHEN u LIKE '%/VBA/%' OR u LIKE 'VBA/%' THEN 'vba-module-stream' WHEN u LIKE '%OLE10NATIVE' THEN 'ole-native-payload' WHEN u = 'PACKAGE' OR u LIKE '%/PACKAGE' THEN 'package-payload' WHEN u LIKE '%/CONTENTS' THEN 'embedded-contents' ELSE 'stream' END AS c
        FROM (SELECT *, upper(path) AS u FROM parts)) GROUP BY c""", "parts"),
)
def cfb_entry_classes(spark, d):
    return V.parts(spark, d).groupBy(S.cfb_entry_class(F.col("path"), F.col("entry_type")).alias("class")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


_ARTIFACT = {
    "ooxml": "CASE WHEN regexp_matches(path, '^(word|xl|ppt)/embeddings/.*\\.(bin|ole)$') THEN 'OleObject' WHEN regexp_matches(path, '^(word|xl|ppt)/media/') THEN 'MediaAsset' WHEN regexp_matches(path, '^(word|xl|ppt)/activeX/.*\\.(bin|dat)$') THEN 'ActiveXControl' END",
    "odf": "CASE WHEN path LIKE 'ObjectReplacements/%' OR (path LIKE 'Object %' AND NOT path LIKE '%/') THEN 'OleObject' WHEN path LIKE 'Pictures/%' THEN 'MediaAsset' END",
    "hwpx": "CASE WHEN path LIKE 'BinData/%' THEN 'MediaAsset' END",
    "cfb": "CASE WHEN upper(path) LIKE '%OBJECTPOOL/%' OR upper(path) LIKE 'BINDATA/%' OR upper(path) LIKE '%OLE10NATIVE' OR upper(path) = 'PACKAGE' OR upper(path) LIKE '%/PACKAGE' OR upper(path) LIKE '%/CONTENTS' THEN 'OleObject' END",
}


@query("artifact_paths", V.sql("SELECT * FROM (" + " UNION ALL ".join(f"SELECT DISTINCT doc_id, path, '{f}' AS format, {c} AS kind FROM parts" for f, c in _ARTIFACT.items()) + ") WHERE kind IS NOT NULL", "parts"))
def artifact_paths(spark, d):
    """Parts that would be extracted, for each format's rules, each path once."""
    rules = F.inline(F.array(*(F.struct(F.lit(f).alias("format"), S.artifact_kind(F.col("path"), f).alias("kind")) for f in _ARTIFACT)))
    return V.parts(spark, d).select("doc_id", "path").distinct().select("doc_id", "path", rules).filter("kind is not null")


_HEAD = "list_extract([" + ", ".join(f"'{h}'" for h in V.HEADS) + f"], (l_partkey + l_suppkey) % {len(V.HEADS)} + 1)"
_PAYLOAD = """CASE WHEN h LIKE '4D5A%' THEN 'pe' WHEN h LIKE 'D0CF11E0%' THEN 'office' WHEN h LIKE '504B0304%' AND regexp_matches(lower(name), '\\.(docx|docm|xlsx|xlsm|pptx|pptm)$') THEN 'office' WHEN h LIKE '504B0304%' THEN 'zip' WHEN h LIKE '255044462D%' THEN 'pdf'
  WHEN regexp_matches(h, '^(09|0A|0C|0D|[2-6][0-9A-F]|7[0-9A-E])+$') THEN 'script' ELSE 'unknown' END"""


@query(
    "payload_classes",
    f"""WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, {_HEAD} AS h, CASE l_linenumber % 3 WHEN 0 THEN 'a.DOCX' WHEN 1 THEN 'b.png' ELSE 'c.bin' END AS name FROM lineitem)
    SELECT doc_id, ord, {_PAYLOAD} AS payload, CASE WHEN name = 'b.png' THEN 'image' ELSE {_PAYLOAD} END AS media, regexp_matches(h, '^(09|0A|0C|0D|[2-6][0-9A-F]|7[0-9A-E])+$') AS is_text FROM p""",
)
def payload_classes(spark, d):
    head = F.element_at(F.array(*(F.lit(h) for h in V.HEADS)), ((F.col("l_partkey") + F.col("l_suppkey")) % len(V.HEADS) + 1).cast("int"))
    name = F.element_at(F.array(*(F.lit(n) for n in ("a.DOCX", "b.png", "c.bin"))), F.col("l_linenumber") % 3 + 1)
    rows = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), S.decoded_hex(head).alias("data"), name.alias("name"))
    return rows.select("doc_id", "ord", S.payload_class(F.col("data"), F.col("name")).alias("payload"), S.media_class(F.col("name"), F.col("data")).alias("media"), S.looks_like_text(F.col("data")).alias("is_text"))


@query("hwpx_security_flags", V.sql("SELECT doc_id, bool_or(contains(lower(path), 'encrypt')) AS encrypted, bool_or(contains(lower(path), 'protect') OR contains(lower(path), 'password')) AS protected, count(*) FILTER (WHERE path LIKE 'Scripts/%' OR lower(path) LIKE '%.js') AS scripts FROM parts GROUP BY doc_id", "parts"))
def hwpx_security_flags(spark, d):
    path = F.lower("path")
    return V.parts(spark, d).groupBy("doc_id").agg(F.bool_or(path.contains("encrypt")).alias("encrypted"), F.bool_or(path.contains("protect") | path.contains("password")).alias("protected"), F.count_if(F.col("path").startswith("Scripts/") | path.endswith(".js")).alias("scripts"))


# URLs

_DECODED = "array_to_string(list_transform(string_split(lower(url), '%'), lambda p, i: CASE WHEN i = 1 THEN p WHEN regexp_matches(p, '^[0-9a-f]{2}') THEN lower(chr(CAST(('0x' || left(p, 2)) AS INT))) || substr(p, 3) ELSE '%' || p END), '')"
_REST = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(decoded, '^(https?|ftp|smb|sftp|file|ldaps?)://', ''), '^.*@', ''), '[/?#\\].*$', ''), '\.+$', '')"
_OCTET, _G = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})", "[0-9a-fA-F]{1,4}"


@query(
    "url_scalars",
    V.sql(rf"""+a AS (SELECT page_id, url, {_DECODED} AS decoded FROM urls), b AS (SELECT *, {_REST} AS rest FROM a),
        c AS (SELECT *, regexp_replace(CASE WHEN rest LIKE '[%' THEN regexp_extract(rest, '^\[([^\]]*)', 1) ELSE regexp_replace(rest, ':.*$', '') END, '\.+$', '') AS host FROM b),
        e AS (SELECT *, regexp_matches(host, '^({_OCTET}\.){{3}}{_OCTET}$') OR regexp_matches(host, '^({_G}:){{7}}{_G}$') OR (regexp_matches(host, '^({_G}(:{_G})*)?::({_G}(:{_G})*)?$') AND len(regexp_extract_all(host, '{_G}')) <= 7) OR regexp_matches(host, '^0[xX]0*[0-9a-fA-F]{{1,8}}$') AS is_ip FROM c)
        SELECT page_id, decoded, host, is_ip, is_ip OR regexp_matches(host, '\.(ru|cn|tk|ml|ga|cf)$') OR regexp_matches(host, '^(.*\.)?(pastebin\.com|bit\.ly|tinyurl\.com|raw\.githubusercontent\.com|ngrok\.io|serveo\.net)$') OR regexp_matches(decoded, '^(\\\\|//)') AS suspicious,
          contains(url, '://') OR regexp_matches(lower(url), '^(file|smb|ftp|mailto):') AS external, regexp_matches(url, '^(//|\\\\|[A-Za-z][A-Za-z0-9+.-]*:)') AS looks_external FROM e""", "urls"),
)
def url_scalars(spark, d):
    url, decoded = F.col("url"), S.percent_decoded(F.col("url"))
    host = S.url_host(decoded)
    return V.urls(spark, d).select("page_id", decoded.alias("decoded"), host.alias("host"), S.is_ip_address(host).alias("is_ip"), S.is_suspicious_url(url).alias("suspicious"), S.is_external_target(url).alias("external"), S.looks_external(url).alias("looks_external"))


# Coverage

OVERRIDES = {"word/document.xml": "application/x-main+xml", "xl/workbook.xml": "application/x-workbook+xml", "ppt/slides/slide1.xml": "application/x-slide+xml", "docprops/core.xml": "application/x-core+xml"}
DEFAULTS = {"xml": "application/xml", "rels": "application/x-relationships+xml", "png": "image/png", "jpeg": "image/jpeg", "bin": "application/x-ole"}
REGISTRY = (
    ("word/document.xml", "application/x-main+xml", "document"), ("word/styles.xml", None, "styles"), ("word/media/*", None, "media"), ("word/embeddings/*.bin", None, "ole"),
    ("word/activeX/*.xml", None, "activex"), ("xl/workbook.xml", "application/x-main+xml", "workbook"), ("xl/worksheets/sheet*.xml", None, "worksheet"), ("ppt/slides/slide*.xml", "application/x-slide+xml", "slide"),
    ("docProps/*", None, "properties"), ("customXml/item*.xml", None, "custom-xml"), ("*.rels", None, "relationships"), ("xl/charts/*", None, "chart"), ("word/glossary/*", None, "glossary"),
)
_map = lambda pairs, key: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"
_COVER = f"""+r(pattern, expected, parser) AS (VALUES {", ".join(f"('{p}', {'NULL' if e is None else chr(39) + e + chr(39)}, '{n}')" for p, e, n in REGISTRY)}),
t AS (SELECT *, coalesce({_map(OVERRIDES, 'lower(path)')}, {_map(DEFAULTS, _EXT)}) AS content_type FROM parts WHERE NOT path LIKE '%/' AND NOT path LIKE '[trash]/%'),
c AS (SELECT t.doc_id, t.ord, t.path, r.pattern, r.parser, t.content_type, CASE WHEN seen THEN 'complete' ELSE 'pending' END AS status FROM t JOIN r ON lower(path) LIKE replace(replace(lower(pattern), '_', '\\_'), '*', '%') ESCAPE '\\' AND (expected IS NULL OR content_type IS NULL OR expected = content_type))
"""


def _coverage(spark, d) -> tuple[DataFrame, DataFrame]:
    parts = coverage.with_content_type(coverage.counted_parts(V.parts(spark, d)), OVERRIDES, DEFAULTS)
    return parts, spark.createDataFrame(list(REGISTRY), "pattern string, expected string, parser string")


@query("coverage_parts", V.sql(f"{_COVER} SELECT * FROM c", "parts"))
def coverage_parts(spark, d):
    return coverage.matched(*_coverage(spark, d))


@query(
    "coverage_counts",
    V.sql(f"""{_COVER} SELECT doc_id, coalesce(matched, 0) AS matched, coalesce(complete, 0) AS complete, coalesce(pending, 0) AS pending, {len(REGISTRY)} - coalesce(patterns, 0) AS missing, unknown FROM (SELECT doc_id, count(*) FILTER (WHERE content_type IS NULL) AS unknown FROM t GROUP BY doc_id)
        LEFT JOIN (SELECT doc_id, count(*) AS matched, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'pending') AS pending, count(DISTINCT pattern) AS patterns FROM c GROUP BY doc_id) USING (doc_id)""", "parts"),
)
def coverage_counts(spark, d):
    return coverage.counts(*_coverage(spark, d), len(REGISTRY))


@query("coverage_missing_patterns", V.sql(f"{_COVER} SELECT pattern, parser FROM r WHERE pattern NOT IN (SELECT pattern FROM c)", "parts"))
def coverage_missing_patterns(spark, d):
    return coverage.missing(*_coverage(spark, d))


@query("coverage_content_types", V.sql(f"{_COVER} SELECT coalesce(content_type, 'unknown') AS content_type, count(*) AS n FROM t GROUP BY 1", "parts"))
def coverage_content_types(spark, d):
    parts, _ = _coverage(spark, d)
    return parts.groupBy(F.coalesce("content_type", F.lit("unknown")).alias("content_type")).agg(F.count("*").alias("n"))


@query("unparsed_parts", V.sql(f"{_COVER} SELECT DISTINCT doc_id, path FROM t WHERE (doc_id, path) NOT IN (SELECT doc_id, path FROM c)", "parts"))
def unparsed_parts(spark, d):
    parts, registry = _coverage(spark, d)
    return coverage.unparsed(parts, coverage.matched(parts, registry).select("doc_id", "path"))


# Directory

_REACH = "reach AS (SELECT slot FROM slots WHERE slot = 1 UNION SELECT p.target FROM reach r JOIN pointers p ON p.source = r.slot JOIN slots s ON s.slot = p.target)"
_TAGS = f"""+{_REACH}, x AS (SELECT i.*, r.slot IS NOT NULL AS reached, (SELECT max(slot) + 1 FROM slots) AS total FROM incoming i LEFT JOIN reach r ON r.slot = i.slot),
two AS (SELECT p.source AS slot, p.kind AS k1, q.kind AS k2 FROM pointers p JOIN pointers q ON q.source = p.target AND q.target = p.source),
three AS (SELECT p.source AS slot, p.kind AS k1, q.kind AS k2, r.kind AS k3 FROM pointers p JOIN pointers q ON q.source = p.target JOIN pointers r ON r.source = q.target AND r.target = p.source),
tags AS (SELECT slot, unnest([CASE WHEN state = 'free' THEN 'free-slot' END, CASE WHEN state = 'orphaned' THEN 'orphaned-entry' END, CASE WHEN entry_type = 'unknown' THEN 'unknown-entry-type' END, CASE WHEN state <> 'free' AND name_length = 0 THEN 'zero-name-length' END,
    CASE WHEN state <> 'free' AND entry_type <> 'unknown' AND size > 0 AND "start" NOT IN (4294967295, 4294967294) AND "start" >= 900 THEN 'invalid-start-sector' END,
    CASE WHEN "left" >= total THEN 'dangling-left-sibling' END, CASE WHEN "right" >= total THEN 'dangling-right-sibling' END, CASE WHEN child >= total THEN 'dangling-child' END,
    CASE WHEN "left" = slot THEN 'self-left-sibling' END, CASE WHEN "right" = slot THEN 'self-right-sibling' END, CASE WHEN child = slot THEN 'self-child' END,
    CASE WHEN state = 'normal' AND entry_type <> 'root-storage' AND refs = 0 THEN 'unreferenced-live-entry' END, CASE WHEN refs > 1 THEN 'multi-referenced-entry' END,
    CASE WHEN state = 'normal' AND entry_type <> 'root-storage' AND NOT reached THEN 'unreachable-live-entry' END, CASE WHEN bad_refs > 0 THEN 'incoming-from-anomalous-entry' END]) AS tag FROM x
  UNION ALL (SELECT slot, CASE WHEN k1 = 'child' THEN 'child-2-cycle' ELSE 'sibling-2-cycle' END FROM two WHERE (k1 = 'child') = (k2 = 'child') UNION SELECT slot, 'mixed-2-cycle' FROM two WHERE k1 <> k2
    UNION SELECT slot, CASE WHEN k1 = 'child' THEN 'child-3-cycle' ELSE 'sibling-3-cycle' END FROM three WHERE k1 = 'child' OR k3 <> 'child' UNION SELECT slot, 'mixed-3-cycle' FROM three WHERE k1 <> k2 OR k1 <> k3))
"""
_SEVERITY = "CASE WHEN tag IN (" + ", ".join(f"'{t}'" for t in directory.SEVERITY["high"]) + ") THEN 'high' WHEN tag IN (" + ", ".join(f"'{t}'" for t in directory.SEVERITY["low"]) + ") THEN 'low' ELSE 'medium' END"


def _tags(spark, d) -> DataFrame:
    return directory.tags(V.slots(spark, d), reachable_slots(spark, d), 900)


@query("directory_entry_tags", V.sql(f"{_TAGS} SELECT slot, tag FROM tags WHERE tag IS NOT NULL", "incoming", recursive=True))
def directory_entry_tags(spark, d):
    return _tags(spark, d)


@query("directory_tag_counts", V.sql(f"{_TAGS} SELECT tag, {_SEVERITY} AS severity, count(*) AS n FROM tags WHERE tag IS NOT NULL GROUP BY ALL", "incoming", recursive=True))
def directory_tag_counts(spark, d):
    return _tags(spark, d).groupBy("tag", directory.tag_severity(F.col("tag")).alias("severity")).agg(F.count("*").alias("n"))


@query("directory_severity_counts", V.sql(f"{_TAGS} SELECT {_SEVERITY} AS severity, count(*) AS n FROM tags WHERE tag IS NOT NULL GROUP BY ALL", "incoming", recursive=True))
def directory_severity_counts(spark, d):
    return _tags(spark, d).groupBy(directory.tag_severity(F.col("tag")).alias("severity")).agg(F.count("*").alias("n"))


@query(
    "directory_score",
    V.sql(f"{_TAGS} SELECT CASE WHEN bool_or({_SEVERITY} = 'high') THEN 'high' WHEN bool_or({_SEVERITY} = 'medium') THEN 'medium' ELSE 'low' END AS score, count(*) AS entries FROM tags JOIN slots USING (slot) WHERE tag IS NOT NULL AND state <> 'free'", "incoming", recursive=True),
)
def directory_score(spark, d):
    """The worst tag of the entries that are not free, and the number of their tags."""
    kept = _tags(spark, d).join(V.slots(spark, d).filter("state <> 'free'").select("slot"), "slot", "left_semi")
    has = lambda level: F.bool_or(directory.tag_severity(F.col("tag")) == level)
    return kept.agg(F.when(has("high"), "high").when(has("medium"), "medium").otherwise("low").alias("score"), F.count("*").alias("entries"))


@query("short_cycle_counts", V.sql(f"{_TAGS} SELECT tag AS bucket, count(*) AS n FROM tags WHERE tag LIKE '%-cycle' GROUP BY tag", "incoming", recursive=True))
def short_cycle_counts(spark, d):
    return directory.cycle_tags(V.slots(spark, d)).groupBy(F.col("tag").alias("bucket")).agg(F.count("*").alias("n"))


@query("live_fanout_counts", V.sql("SELECT unnest([b, CASE WHEN state = 'normal' THEN 'live-' || b END]) AS bucket, count(*) AS n FROM (SELECT state, 'fanout:' || (CAST(\"left\" IS NOT NULL AS INT) + CAST(\"right\" IS NOT NULL AS INT) + CAST(child IS NOT NULL AS INT)) AS b FROM slots) GROUP BY 1 HAVING bucket IS NOT NULL", "slots"))
def live_fanout_counts(spark, d):
    b = F.concat(F.lit("fanout:"), sum((F.col(k).isNotNull().cast("int") for k in directory.POINTERS), F.lit(0)).cast("string"))
    both = F.array_compact(F.array(b, F.when(F.col("state") == "normal", F.concat(F.lit("live-"), b))))
    return V.slots(spark, d).select(F.explode(both).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


# Sectors

_HEALTH = """+sh AS (SELECT sector FROM chains GROUP BY sector HAVING count(DISTINCT stream) > 1), st AS (SELECT start FROM streams WHERE start <> 4294967295 GROUP BY start HAVING count(*) > 1),
h AS (SELECT s.*, CASE WHEN got < expected THEN 'truncated' ELSE 'complete' END AS state, s.stream IN (SELECT stream FROM chains WHERE sector IN (SELECT sector FROM sh)) AS shared, s.start IN (SELECT start FROM st) AS reused, size > 0 AND start <> 4294967295 AND start <> "first" AS invalid FROM streams s)
"""
_RISK = "CASE WHEN shared OR invalid THEN 'high' WHEN reused OR state = 'truncated' THEN 'medium' ELSE 'none' END"


def _health(spark, d) -> DataFrame:
    rows = stored(V.chains(spark, d))  # read three times
    return sectors.tagged(V.streams(spark, d, rows), rows)


@query("stream_risks", V.sql(f"{_HEALTH} SELECT stream, path, CASE WHEN invalid THEN 'invalid-start' WHEN shared THEN 'shared' WHEN state = 'complete' AND reused THEN 'start-reused' ELSE state END AS health, {_RISK} AS risk FROM h", "streams"))
def stream_risks(spark, d):
    return sectors.health(_health(spark, d)).select("stream", "path", "health", "risk")


@query(
    "chain_health_counts",
    V.sql(f"""{_HEALTH}, g AS (SELECT root, allocation, unnest([state, CASE WHEN shared THEN 'shared' END, CASE WHEN reused THEN 'start-reused' END, CASE WHEN invalid THEN 'invalid-start' END]) AS tag FROM h)
        SELECT bucket, count(*) AS n FROM (SELECT unnest(['health:' || tag || ':root:' || root, 'health:' || tag || ':allocation:' || allocation]) AS bucket FROM g WHERE tag IS NOT NULL) GROUP BY bucket""", "streams"),
)
def chain_health_counts(spark, d):
    return sectors.health_counts(_health(spark, d))


@query("truncated_chain_counts", V.sql(f"{_HEALTH} SELECT allocation || ':' || root AS bucket, count(*) AS n FROM h WHERE state = 'truncated' GROUP BY 1", "streams"))
def truncated_chain_counts(spark, d):
    return sectors.truncated_counts(_health(spark, d))


@query("sector_score", V.sql(f"{_HEALTH} SELECT CASE WHEN bool_or({_RISK} = 'high') THEN 'high' WHEN bool_or({_RISK} = 'medium') THEN 'medium' ELSE 'none' END AS score, count(*) AS streams FROM h", "streams"))
def sector_score(spark, d):
    return sectors.score(sectors.health(_health(spark, d)))


_SECTORS = """+sec AS (SELECT CAST(p_partkey AS BIGINT) + 5 AS sector, CASE p_size % 5 WHEN 0 THEN 4294967295 WHEN 1 THEN 4294967294 WHEN 2 THEN 4294967292 ELSE p_size END AS fat, CASE WHEN p_partkey % 7 = 0 THEN 'directory' WHEN p_partkey % 11 = 0 THEN 'mini-fat' END AS special FROM part),
k AS (SELECT s.*, c.sector IS NOT NULL AS claimed FROM sec s LEFT JOIN (SELECT DISTINCT CAST(sector AS BIGINT) AS sector FROM chains) c ON c.sector = s.sector)
"""


def _sectors(spark, d) -> DataFrame:
    """Parts as sectors of an allocation table."""
    k, size = F.col("p_partkey").cast("long"), F.col("p_size")
    fat = F.when(size % 5 == 0, F.lit(0xFFFFFFFF)).when(size % 5 == 1, F.lit(0xFFFFFFFE)).when(size % 5 == 2, F.lit(0xFFFFFFFC)).otherwise(size.cast("long"))
    return V.table(spark, d, "part").select((k + 5).alias("sector"), fat.alias("fat"), F.when(k % 7 == 0, "directory").when(k % 11 == 0, "mini-fat").alias("special"))


@query("sector_role_counts", V.sql(f"{_SECTORS} SELECT role, count(*) AS n FROM (SELECT unnest([CASE WHEN claimed THEN 'stream-data' WHEN fat = 4294967295 THEN 'free' WHEN fat = 4294967294 THEN 'end-of-chain' WHEN fat = 4294967292 THEN 'fat' ELSE 'next-sector' END, 'special:' || CASE WHEN fat = 4294967292 THEN 'fat-table' ELSE special END]) AS role FROM k) WHERE role IS NOT NULL GROUP BY role", "chains"))
def sector_role_counts(spark, d):
    return sectors.roles(_sectors(spark, d), V.chains(spark, d))


@query(
    "structural_incoherence",
    V.sql("""+sec AS (SELECT CAST(p_partkey AS BIGINT) + 5 AS sector, CASE p_size % 5 WHEN 0 THEN 4294967295 WHEN 1 THEN 4294967294 WHEN 2 THEN 4294967292 ELSE p_size END AS fat, CASE WHEN p_partkey % 7 = 0 THEN 'directory' WHEN p_partkey % 11 = 0 THEN 'mini-fat' END AS special FROM part),
        k AS (SELECT s.*, c.sector IS NOT NULL AS claimed FROM sec s LEFT JOIN (SELECT DISTINCT CAST(sector AS BIGINT) AS sector FROM chains) c ON c.sector = s.sector WHERE special IS NOT NULL)
        SELECT special || ':claimed-by-stream' AS bucket, 'medium' AS severity, count(*) AS n FROM k WHERE claimed GROUP BY 1 UNION ALL SELECT special || ':marked-free', 'high', count(*) FROM k WHERE NOT claimed AND fat = 4294967295 GROUP BY 1
        UNION ALL SELECT 'start-sector-mismatch:' || path, 'high', count(*) FROM streams WHERE size > 0 AND start <> "first" GROUP BY 1""", "streams"),
)
def structural_incoherence(spark, d):
    return sectors.special_incoherence(_sectors(spark, d), V.chains(spark, d)).unionByName(sectors.start_mismatches(V.streams(spark, d)))


# Joins of parts that name one another


@query("shared_string_lookup", "SELECT l_orderkey AS doc_id, l_linenumber AS cell, coalesce(p_name, '#' || l_partkey) AS value FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 10 <> 0")
def shared_string_lookup(spark, d):
    """A cell's shared string, or its index as text where the table lacks it."""
    strings = V.table(spark, d, "part").filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return V.table(spark, d, "lineitem").join(strings, "l_partkey", "left").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("cell"), F.coalesce("p_name", F.concat(F.lit("#"), F.col("l_partkey").cast("string"))).alias("value"))


@query("sheet_relationship_parts", "SELECT o_orderkey AS sheet, c_name AS target, n_name AS part FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 2")
def sheet_relationship_parts(spark, d):
    """Sheet, its relationship's target and that target's part, null where the package lacks it."""
    sheets, rels = V.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), V.table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    parts = V.table(spark, d, "nation").filter("n_regionkey <> 2").select("n_nationkey", "n_name")
    return sheets.join(rels, "c_custkey").join(parts, "n_nationkey", "left").select(F.col("o_orderkey").alias("sheet"), F.col("c_name").alias("target"), F.col("n_name").alias("part"))


@query("validation_definitions", "SELECT l_orderkey AS sheet, l_linenumber AS range, coalesce(p_brand, 'default') AS definition FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size < 25")
def validation_definitions(spark, d):
    definitions = V.table(spark, d, "part").filter("p_size < 25").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return V.table(spark, d, "lineitem").join(definitions, "l_partkey", "left").select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("range"), F.coalesce("p_brand", F.lit("default")).alias("definition"))


@query("external_hyperlink_rels", V.sql(f"SELECT h.doc_id, h.node_id, r.target FROM objects h JOIN objects r ON r.doc_id = h.doc_id AND r.node_type = 'ExternalReference' AND r.number % 5 = h.number % 5 AND {_EXTERNAL.replace('target', 'r.target')} WHERE h.node_type = 'Hyperlink'", "objects"))
def external_hyperlink_rels(spark, d):
    rows = V.objects(spark, d)
    rels = rows.filter("node_type = 'ExternalReference'").filter(S.looks_external(F.col("target"))).select("doc_id", (F.col("number") % 5).alias("slot"), "target")
    return rows.filter("node_type = 'Hyperlink'").select("doc_id", "node_id", (F.col("number") % 5).alias("slot")).join(rels, ["doc_id", "slot"]).select("doc_id", "node_id", "target")


@query(
    "media_path_links",
    V.sql("""+want AS (SELECT DISTINCT doc_id, path AS target FROM parts WHERE path LIKE '%media/%' OR path LIKE 'docProps/%'), have AS (SELECT doc_id, path, min(ord) AS node FROM parts WHERE ord <= 4 GROUP BY ALL)
        SELECT doc_id, target, node FROM (SELECT w.doc_id, w.target, h.node, row_number() OVER (PARTITION BY w.doc_id, w.target ORDER BY h.path <> w.target, h.node) AS r FROM want w JOIN have h ON h.doc_id = w.doc_id AND (h.path = w.target OR ends_with(h.path, w.target) OR ends_with(w.target, h.path))) WHERE r = 1""", "parts"),
)
def media_path_links(spark, d):
    """A shape's media target and the part it means: an equal path, else the first of those of which either ends with
    the other. The join is on the document, so the suffix test runs inside one package."""
    rows = V.parts(spark, d)
    want = rows.filter(F.col("path").contains("media/") | F.col("path").startswith("docProps/")).select("doc_id", F.col("path").alias("target")).distinct()
    have = rows.filter("ord <= 4").groupBy("doc_id", "path").agg(F.min("ord").alias("node"))
    pairs = want.join(have, "doc_id").filter((F.col("path") == F.col("target")) | F.endswith("path", F.col("target")) | F.endswith("target", F.col("path")))
    return pairs.groupBy("doc_id", "target").agg(F.min(F.struct((F.col("path") != F.col("target")).alias("other"), "node")).alias("x")).select("doc_id", "target", "x.node")


_EVIDENCE = f"""{_TAGS}, {_HEALTH.removeprefix("+").rstrip()},
evidence AS (SELECT 'directory:cycle:' || tag AS evidence, count(*) AS n FROM tags WHERE tag LIKE '%-cycle' GROUP BY tag
  UNION ALL SELECT 'directory:reachability:live-unreachable', count(*) FROM tags WHERE tag = 'unreachable-live-entry' HAVING count(*) > 0
  UNION ALL SELECT 'directory:invalid-start', count(*) FROM tags WHERE tag = 'invalid-start-sector' HAVING count(*) > 0
  UNION ALL SELECT 'sector:shared-sector', count(*) FROM sh HAVING count(*) > 0
  UNION ALL SELECT 'sector:truncated-chain:' || allocation || ':' || root, count(*) FROM h WHERE state = 'truncated' GROUP BY ALL
  UNION ALL SELECT 'sector:structural-incoherence:start-sector-mismatch', count(*) FROM streams WHERE size > 0 AND start <> "first" HAVING count(*) > 0)"""


def _evidence(spark, d) -> DataFrame:
    tag = F.col("tag")
    named = F.when(tag.endswith("-cycle"), F.concat(F.lit("directory:cycle:"), tag)).when(tag == "unreachable-live-entry", "directory:reachability:live-unreachable").when(tag == "invalid-start-sector", "directory:invalid-start")
    entries = _tags(spark, d).select(named.alias("evidence")).filter("evidence is not null").groupBy("evidence").agg(F.count("*").alias("n"))
    total = lambda rows, name: rows.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(name).alias("evidence"), "n")
    streams, chains = V.streams(spark, d), V.chains(spark, d)
    shared = total(records.shared_sectors(chains, "stream", "sector"), "sector:shared-sector")
    cut = sectors.truncated_counts(_health(spark, d)).select(F.concat(F.lit("sector:truncated-chain:"), "bucket").alias("evidence"), "n")
    wrong = total(streams.filter((F.col("size") > 0) & (F.col("start") != F.col("first"))), "sector:structural-incoherence:start-sector-mismatch")
    return reduce(DataFrame.unionByName, (entries, shared, cut, wrong))


@query("structural_evidence", V.sql(f"{_EVIDENCE} SELECT evidence, n FROM evidence", "incoming", "streams", recursive=True))
def structural_evidence(spark, d):
    """All evidence of the directory and the sectors, counted."""
    return _evidence(spark, d)


@query(
    "structural_score",
    V.sql(f"{_EVIDENCE} SELECT CASE WHEN bool_or(evidence LIKE 'sector:s%' OR evidence LIKE 'directory:cycle%') THEN 'high' WHEN bool_or(evidence LIKE 'sector:truncated%' OR evidence LIKE 'directory:reach%') THEN 'medium' WHEN count(*) > 0 THEN 'low' ELSE 'none' END AS score, count(*) AS kinds, CAST(sum(n) AS BIGINT) AS n FROM evidence", "incoming", "streams", recursive=True),
)
def structural_score(spark, d):
    return sectors.structural_score(_evidence(spark, d))


@query(
    "record_anomalies",
    V.sql("""+o AS (SELECT user_id, event_type, size, coalesce(sum(size + 4) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM stream),
        x AS (SELECT o.*, len - off AS rest FROM o JOIN (SELECT user_id, max(off + 4 + size) - user_id % 9 AS len FROM o GROUP BY user_id) l ON l.user_id = o.user_id)
        SELECT user_id, CAST(off AS BIGINT) AS "offset", CASE WHEN rest < 4 THEN 'trailing-bytes' ELSE 'truncated-record' END AS anomaly,
        CASE WHEN rest < 4 THEN rest || ' trailing byte(s) after last complete record header' ELSE 'record 0x000' || length(event_type) || ' declares ' || size || ' byte(s) but stream ends after ' || (rest - 4) END AS message
        FROM x WHERE rest > 0 AND rest < size + 4""", "stream"),
)
def record_anomalies(spark, d):
    """Streams of events of which up to eight bytes are cut off; a record's type is the length of the event's."""
    rows = records.offsets(V.stream(spark, d), "user_id", "size").withColumn("type", F.length("event_type"))
    ends = rows.groupBy("user_id").agg((F.max(F.col("offset") + F.col("size") + records.HEADER) - F.col("user_id") % 9).alias("total"))
    return records.anomalies(rows.join(ends, "user_id"), "size", "type", "total").select("user_id", "offset", "anomaly", "message")


# Windows, scalars and keys


@query("repeated_rows", "SELECT l_orderkey AS sheet, before + unnest(generate_series(0, rep - 1)) AS row, l_partkey AS value FROM (SELECT *, coalesce(sum(rep) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM (SELECT *, CAST(l_quantity AS BIGINT) % 4 AS rep FROM lineitem)) WHERE rep > 0")
def repeated_rows(spark, d):
    """Rows with a repeat count: the index goes on by it, and each repetition is a row."""
    rows = V.table(spark, d, "lineitem").withColumn("rep", F.col("l_quantity").cast("long") % 4)
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("rep").over(w), F.lit(0))).filter("rep > 0")
    return rows.select(F.col("l_orderkey").alias("sheet"), F.col("l_partkey").alias("value"), F.explode(F.sequence("before", F.col("before") + F.col("rep") - 1)).alias("row"))


@query("node_ids_parsed", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey END AS id FROM orders")
def node_ids_parsed(spark, d):
    """``node_<hex>`` and decimal ids; other texts give none."""
    k = F.col("o_orderkey").cast("long")
    text = F.when(k % 3 == 0, F.concat(F.lit("node_"), F.lower(F.hex(k)))).when(k % 3 == 1, k.cast("string")).otherwise(F.concat(F.lit("node-"), k.cast("string")))
    return V.table(spark, d, "orders").select("o_orderkey", S.node_id(text).alias("id"))


@query("cells_within_limits", "SELECT p_partkey, p_partkey * 997 < 1048576 AND p_size * 401 < 16384 AS valid FROM part")
def cells_within_limits(spark, d):
    return V.table(spark, d, "part").select("p_partkey", S.within_sheet(F.col("p_partkey").cast("long") * 997, F.col("p_size").cast("long") * 401).alias("valid"))


@query(
    "index_path_keys",
    V.sql("""+n AS (SELECT 'R' || r_regionkey AS id, 'Region[' || r_name || ']' AS key FROM region),
        l1 AS (SELECT 'N' || n_nationkey AS id, n.key || '/Nation[' || left(n_name, 3) || ']' || CASE WHEN r > 1 THEN '#' || r ELSE '' END AS key FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey, left(n_name, 3) ORDER BY n_nationkey) AS r FROM nation) x JOIN n ON n.id = 'R' || n_regionkey),
        l2 AS (SELECT 'C' || c_custkey AS id, l1.key || '/Customer[' || r || ']' AS key FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) x JOIN l1 ON l1.id = 'N' || c_nationkey)
        SELECT * FROM n UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2""", "tree"),
)
def index_path_keys(spark, d):
    """Path keys of a tree: a node's own key where its type has one (with ``#n`` from the second equal one on), else
    its type and place among its siblings."""
    region = V.table(spark, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("id"), F.concat(F.lit("Region["), "r_name", F.lit("]")).alias("key"))
    own = F.concat(F.lit("Nation["), F.substring("n_name", 1, 3), F.lit("]"))
    nations = V.table(spark, d, "nation").select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").alias("ord"), own.alias("local"))
    nation = summaries.allotted(nations, "local", ["parent"], ["ord"], stored).drop("ord")
    placed = ranked(V.table(spark, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], ["c_custkey"], stored)
    customer = placed.select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("parent"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("Customer["), F.col("place").cast("string"), F.lit("]")).alias("local"))
    below = lambda rows, above: rows.join(above.select(F.col("id").alias("parent"), "key"), "parent").select("id", F.concat_ws("/", "key", "local").alias("key"))
    second = below(nation, region)
    return reduce(DataFrame.unionByName, (region, second, below(customer, second)))


@query(
    "preorder_walk",
    V.sql("""+walk AS (SELECT 'R' || r_regionkey AS root, 'R' || r_regionkey AS node, 0::BIGINT AS depth, [0::BIGINT] AS place FROM region
        UNION ALL SELECT w.root, t.child, w.depth + 1, list_append(w.place, CAST(substr(t.child, 2) AS BIGINT)) FROM walk w JOIN tree t ON t.parent = w.node AND NOT w.node LIKE 'C%' )
        SELECT root, node, depth, row_number() OVER (PARTITION BY root ORDER BY place) AS visit FROM walk""", "tree", recursive=True),
)
def preorder_walk(spark, d):
    """Regions, nations and customers in pre-order; the walk skips what lies below customers."""
    edges = V.tree(spark, d).select("parent", "child", F.substring("child", 2, 20).cast("long").alias("ord"))
    roots = V.table(spark, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("root"))
    return trees.visits(edges, roots, stored, skip=F.col("node").startswith("C"))
