"""Registered document-IR queries and their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.operators import diff, directory, formula, ir, objects, records, security
from docloom.plans import views as V
from docloom.storage import stored

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL that must give the same rows."""

    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return add


long = lambda c, name: F.col(c).cast("long").alias(name) if isinstance(c, str) else c.cast("long").alias(name)


# Projection, filter and traversal


@query("grep_paragraph", V.sql("SELECT doc_id, 1 + 2 * ord AS node_id, 'Paragraph' AS node_type FROM paragraphs WHERE contains(lower(text), 'idiot')", "paragraphs"))
def grep_paragraph(spark, d):
    nodes = ir.text_nodes(V.table(spark, d, "documents"))
    return ir.select_nodes(nodes, ("Paragraph",), "idiot").select("doc_id", long("node_id", "node_id"), "node_type")


@query(
    "query_document_passthrough",
    V.sql("SELECT doc_id, 0 AS node_id, 'Document' AS node_type FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, 1 + 2 * ord, 'Paragraph' FROM paragraphs UNION ALL SELECT doc_id, 2 + 2 * ord, 'Run' FROM paragraphs", "paragraphs"),
)
def query_document_passthrough(spark, d):
    nodes = ir.text_nodes(V.table(spark, d, "documents"), "lang")
    return ir.select_nodes(nodes, document=F.col("lang") == "de").select("doc_id", long("node_id", "node_id"), "node_type")


@query(
    "extract_by_id_or_type",
    V.sql("SELECT doc_id, 1 + 2 * ord AS node_id, text FROM paragraphs WHERE 1 + 2 * ord IN (1, 3) UNION ALL SELECT doc_id, 2 + 2 * ord, text FROM paragraphs", "paragraphs"),
)
def extract_by_id_or_type(spark, d):
    nodes = ir.text_nodes(V.table(spark, d, "documents"))
    both = nodes.filter(F.col("node_id").isin(1, 3)).unionAll(nodes.filter(F.col("node_type") == "Run"))
    return both.select("doc_id", long("node_id", "node_id"), "text")


@query(
    "closure_preorder",
    V.sql(
        """+walk AS (SELECT parent AS root, parent AS node, 0 AS depth FROM (SELECT DISTINCT parent FROM tree WHERE parent LIKE 'R%')
        UNION ALL SELECT w.root, t.child, w.depth + 1 FROM walk w JOIN tree t ON t.parent = w.node)
        SELECT root, node, CAST(depth AS BIGINT) AS depth FROM walk""", "tree", recursive=True),
)
def closure_preorder(spark, d):
    edges = V.tree(spark, d)
    roots = edges.filter("parent like 'R%'").select(F.col("parent").alias("root")).distinct()
    return ir.closure(edges, roots, stored).select("root", "node", long("depth", "depth"))


@query("text_collector", V.sql("SELECT doc_id, sha256(string_agg(text, chr(10) ORDER BY ord)) AS digest, CAST(length(string_agg(text, chr(10) ORDER BY ord)) AS BIGINT) AS chars FROM paragraphs GROUP BY doc_id", "paragraphs"))
def text_collector(spark, d):
    return ir.collected_text(V.paragraphs(spark, d)).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), long(F.length("text"), "chars"))


# Aggregations


@query("node_type_counts", V.sql("SELECT kind AS node_type, count(*) AS n FROM (SELECT kind FROM tree UNION ALL SELECT 'Region' FROM region) GROUP BY kind", "tree"))
def node_type_counts(spark, d):
    rows = V.tree(spark, d).select("kind").unionAll(V.table(spark, d, "region").select(F.lit("Region")))
    return rows.groupBy(F.col("kind").alias("node_type")).agg(F.count("*").alias("n"))


@query(
    "text_stats",
    V.sql(r"SELECT doc_id, count(*) AS runs, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(regexp_extract_all(text, '[^ \t\r\n\f]+'))) AS BIGINT) AS words FROM paragraphs GROUP BY doc_id", "paragraphs"),
)
def text_stats(spark, d):
    return ir.text_stats(V.paragraphs(spark, d))


@query("ir_summary_distinct_runs", V.sql("SELECT count(*) AS runs, count(DISTINCT text) FILTER (WHERE text <> '') AS distinct_texts, count(DISTINCT doc_id) AS documents FROM paragraphs", "paragraphs"))
def ir_summary_distinct_runs(spark, d):
    rows = V.paragraphs(spark, d)
    return rows.agg(F.count("*").alias("runs"), F.count_distinct(F.when(F.col("text") != "", F.col("text"))).alias("distinct_texts"), F.count_distinct("doc_id").alias("documents"))


@query(
    "dimension_histogram",
    """SELECT bucket, count(*) AS n FROM (SELECT unnest(['state:' || o_orderstatus, 'priority:' || o_orderpriority,
    'class:' || CASE WHEN o_totalprice >= 300000 THEN 'large' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'small' END]) AS bucket FROM orders) GROUP BY bucket""",
)
def dimension_histogram(spark, d):
    size = F.when(F.col("o_totalprice") >= 300000, "large").when(F.col("o_totalprice") >= 100000, "medium").otherwise("small")
    keys = F.array(F.concat(F.lit("state:"), "o_orderstatus"), F.concat(F.lit("priority:"), "o_orderpriority"), F.concat(F.lit("class:"), size))
    return V.table(spark, d, "orders").select(F.explode(keys).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query(
    "reference_bucket_counts",
    V.sql("""SELECT bucket, count(*) AS n FROM (SELECT unnest([b, CASE WHEN state = 'normal' THEN 'live-' || b END]) AS bucket FROM (
        SELECT state, CASE WHEN refs = 0 THEN 'zero' WHEN refs = 1 THEN 'one' ELSE 'many' END AS b FROM incoming)) WHERE bucket IS NOT NULL GROUP BY bucket""", "incoming"),
)
def reference_bucket_counts(spark, d):
    b = F.when(F.col("refs") == 0, "zero").when(F.col("refs") == 1, "one").otherwise("many")
    keys = F.array(b, F.when(F.col("state") == "normal", F.concat(F.lit("live-"), b)))
    return directory.incoming(V.slots(spark, d)).select(F.explode(keys).alias("bucket")).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


@query(
    "incoming_source_counts_zero_kept",
    V.sql("""SELECT unnest(['anomalous', 'free', 'normal']) AS bucket, unnest([a, f, n]) AS n FROM (SELECT CAST(sum(bad_refs) AS BIGINT) AS a,
        CAST(coalesce(sum(refs) FILTER (WHERE state = 'free' AND entry_type = 'root-storage' AND slot > 0), 0) AS BIGINT) AS f, CAST(sum(refs - bad_refs) AS BIGINT) AS n FROM incoming)""", "incoming"),
)
def incoming_source_counts_zero_kept(spark, d):
    rows = directory.incoming(V.slots(spark, d))
    none = F.when((F.col("state") == "free") & (F.col("entry_type") == "root-storage") & (F.col("slot") > 0), F.col("refs"))
    sums = rows.agg(F.sum("bad_refs").alias("anomalous"), F.coalesce(F.sum(none), F.lit(0)).alias("free"), F.sum(F.col("refs") - F.col("bad_refs")).alias("normal"))
    return sums.unpivot([], ["anomalous", "free", "normal"], "bucket", "n")


@query("pointer_counts", V.sql("SELECT kind || CASE WHEN s.slot IS NULL THEN ':dangling' ELSE ':present' END AS bucket, count(*) AS n FROM pointers p LEFT JOIN slots s ON s.slot = p.target GROUP BY 1", "pointers"))
def pointer_counts(spark, d):
    slots = V.slots(spark, d)
    rows = directory.pointer_rows(slots).join(slots.select(F.col("slot").alias("target"), F.lit(True).alias("known")), "target", "left")
    return rows.groupBy(F.concat("kind", F.when(F.col("known").isNull(), ":dangling").otherwise(":present")).alias("bucket")).agg(F.count("*").alias("n"))


@query("tree_density", V.sql("SELECT kind || '/' || b AS bucket, count(*) AS n FROM (SELECT p.kind, unnest([s.state, s.entry_type]) AS b FROM pointers p JOIN slots s ON s.slot = p.source) GROUP BY 1", "pointers"))
def tree_density(spark, d):
    slots = V.slots(spark, d)
    rows = directory.pointer_rows(slots).join(slots.select(F.col("slot").alias("source"), F.explode(F.array("state", "entry_type")).alias("b")), "source")
    return rows.groupBy(F.concat_ws("/", "kind", "b").alias("bucket")).agg(F.count("*").alias("n"))


@query("fanout_counts", V.sql("SELECT 'fanout:' || coalesce(n, 0) AS bucket, count(*) AS n FROM slots LEFT JOIN (SELECT source, count(*) AS n FROM pointers GROUP BY source) ON source = slot GROUP BY 1", "pointers"))
def fanout_counts(spark, d):
    present = sum((F.col(k).isNotNull().cast("int") for k in directory.POINTERS), F.lit(0))
    return V.slots(spark, d).groupBy(F.concat(F.lit("fanout:"), present.cast("string")).alias("bucket")).agg(F.count("*").alias("n"))


@query("content_type_histogram", "SELECT coalesce(nullif(regexp_extract(split_part(url, '?', 1), '\\.([a-z]+)$', 1), ''), 'none') AS content_type, count(*) AS n FROM pages GROUP BY 1")
def content_type_histogram(spark, d):
    ext = F.regexp_extract(F.split_part("url", F.lit("?"), F.lit(1)), r"\.([a-z]+)$", 1)
    return V.table(spark, d, "pages").groupBy(F.when(ext != "", ext).otherwise("none").alias("content_type")).agg(F.count("*").alias("n"))


@query("burst_threshold", V.sql("SELECT doc_id, count(*) AS n FROM links WHERE kind = 'Hyperlink' GROUP BY doc_id HAVING count(*) > 5", "links"))
def burst_threshold(spark, d):
    return V.links(spark, d).filter("kind = 'Hyperlink'").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 5")


@query(
    "status_rollup",
    """SELECT l_orderkey AS project, CASE WHEN bool_or(l_returnflag = 'R') THEN 'Error' WHEN bool_or(l_returnflag = 'A') THEN 'Partial' WHEN bool_and(l_linestatus = 'F') THEN 'Extracted' ELSE 'Recognized' END AS project_status,
    CASE WHEN bool_or(l_returnflag = 'A') THEN 'Partial' WHEN bool_or(l_returnflag = 'R') THEN 'Error' WHEN bool_and(l_linestatus = 'F') THEN 'Extracted' ELSE 'Recognized' END AS document_status FROM lineitem GROUP BY 1""",
)
def status_rollup(spark, d):
    error, partial, done = F.bool_or(F.col("l_returnflag") == "R"), F.bool_or(F.col("l_returnflag") == "A"), F.bool_and(F.col("l_linestatus") == "F")
    rest = lambda c: c.when(done, "Extracted").otherwise("Recognized")
    return V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("project")).agg(
        rest(F.when(error, "Error").when(partial, "Partial")).alias("project_status"), rest(F.when(partial, "Partial").when(error, "Error")).alias("document_status"))


# Windows


@query(
    "substream_index_and_kind",
    V.sql("""SELECT user_id, seq, CAST(sum(CASE WHEN event_type = 'signup' AND seq > 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS substream,
        coalesce(last_value(CASE WHEN event_type = 'signup' THEN 'kind' || event_id % 4 END IGNORE NULLS) OVER w, 'unknown') AS substream_kind
        FROM stream WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""", "stream"),
)
def substream_index_and_kind(spark, d):
    rows = V.stream(spark, d).withColumn("kind", F.concat(F.lit("kind"), (F.col("event_id") % 4).cast("string")))
    return records.substreams(rows, "user_id", F.col("event_type") == "signup", "kind").select("user_id", long("seq", "seq"), "substream", "substream_kind")


_SUBSTREAMS = """+r AS (SELECT user_id, sum(CASE WHEN event_type = 'signup' AND seq > 0 THEN 1 ELSE 0 END) OVER w AS i, coalesce(last_value(CASE WHEN event_type = 'signup' THEN 'kind' || event_id % 4 END IGNORE NULLS) OVER w, 'unknown') AS kind
        FROM stream WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING))"""


@query("substream_counts", V.sql(f"{_SUBSTREAMS} SELECT user_id, i || ':' || kind AS bucket, count(*) AS n FROM r GROUP BY ALL", "stream"))
def substream_counts(spark, d):
    """Records of each substream, under its number and kind."""
    key = F.concat_ws(":", F.col("substream").cast("string"), "substream_kind")
    return substream_index_and_kind(spark, d).groupBy("user_id", key.alias("bucket")).agg(F.count("*").alias("n"))


@query("substream_totals", V.sql(f"{_SUBSTREAMS} SELECT user_id, CAST(max(i) + 1 AS BIGINT) AS substreams FROM r GROUP BY user_id", "stream"))
def substream_totals(spark, d):
    return substream_index_and_kind(spark, d).groupBy("user_id").agg((F.max("substream") + 1).alias("substreams"))


@query("record_offsets", V.sql("SELECT user_id, seq, CAST(coalesce(sum(size + 4) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM stream", "stream"))
def record_offsets(spark, d):
    return records.offsets(V.stream(spark, d), "user_id", "size").select("user_id", long("seq", "seq"), "offset")


@query("record_type_counts", V.sql("SELECT printf('0x%04X', 10 + ascii(event_type)) || ':' || upper(event_type) AS record_type, count(*) AS n FROM stream GROUP BY 1", "stream"))
def record_type_counts(spark, d):
    key = F.format_string("0x%04X:%s", F.lit(10) + F.ascii("event_type"), F.upper("event_type"))
    return V.stream(spark, d).groupBy(key.alias("record_type")).agg(F.count("*").alias("n"))


@query("sibling_ordinal_keys", V.sql("SELECT parent, child, kind || '[' || row_number() OVER (PARTITION BY parent, kind ORDER BY child) || ']' AS key FROM tree", "tree"))
def sibling_ordinal_keys(spark, d):
    return ir.sibling_keys(V.tree(spark, d), "parent", "kind", ["child"], stored).select("parent", "child", "key")


@query(
    "chain_steps",
    V.sql("""SELECT stream, sector, row_number() OVER w - 1 AS step, coalesce(lead(sector) OVER w, -2) AS next, lead(sector) OVER w IS NULL AS is_terminal
        FROM chains WINDOW w AS (PARTITION BY stream ORDER BY pos, sector)""", "chains"),
)
def chain_steps(spark, d):
    return records.chain_steps(V.chains(spark, d), "stream", "sector", ["pos", "sector"]).select("stream", "sector", long("step", "step"), "next", "is_terminal")


@query("shared_sector_claims", V.sql("SELECT sector, count(DISTINCT stream) AS owners, min(stream) AS first_owner FROM chains GROUP BY sector HAVING count(DISTINCT stream) > 1", "chains"))
def shared_sector_claims(spark, d):
    return records.shared_sectors(V.chains(spark, d), "stream", "sector")


@query(
    "start_sector_reuse",
    V.sql("+s AS (SELECT stream, arg_min(sector, CAST(pos AS BIGINT) * 1000000000 + sector) AS sector FROM chains GROUP BY stream) SELECT sector, count(*) AS streams FROM s GROUP BY sector HAVING count(*) > 1", "chains"),
)
def start_sector_reuse(spark, d):
    starts = V.chains(spark, d).groupBy("stream").agg(F.min(F.struct("pos", "sector")).alias("s")).select("s.sector")
    return starts.groupBy("sector").agg(F.count("*").alias("streams")).filter("streams > 1")


@query(
    "shared_chain_islands",
    V.sql("""+p AS (SELECT DISTINCT stream, pos FROM chains), g AS (SELECT stream, pos, pos - row_number() OVER (PARTITION BY stream ORDER BY pos) AS g FROM p)
        SELECT stream, min(pos) AS "first", max(pos) AS "last", count(*) AS length FROM g GROUP BY stream, g HAVING count(*) >= 2""", "chains"),
)
def shared_chain_islands(spark, d):
    return records.islands(V.chains(spark, d).select("stream", "pos").distinct(), "stream", "pos")


# Sorts, limits, top-k


@query(
    "normalize_order",
    V.sql("SELECT parent, child, row_number() OVER (PARTITION BY parent ORDER BY CASE kind WHEN 'Nation' THEN 10 WHEN 'Customer' THEN 20 ELSE 500 END, length(child), child) AS place FROM tree", "tree"),
)
def normalize_order(spark, d):
    rank = F.when(F.col("kind") == "Nation", 10).when(F.col("kind") == "Customer", 20).otherwise(500)
    place = F.row_number().over(W.partitionBy("parent").orderBy(rank, F.length("child"), "child"))
    return V.tree(spark, d).select("parent", "child", long(place, "place"))


@query(
    "dominant_class_top1",
    """SELECT user_id, event_type AS dominant FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1""",
)
def dominant_class_top1(spark, d):
    counted = V.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counted.groupBy("user_id").agg(F.min(F.struct(-F.col("n"), "event_type")).alias("x")).select("user_id", F.col("x.event_type").alias("dominant"))


@query("abbreviate_summary", "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS summary FROM documents")
def abbreviate_summary(spark, d):
    return V.table(spark, d, "documents").select("doc_id", S.abbreviate(F.col("text")).alias("summary"))


# Joins


@query("missing_ids_anti", "SELECT c_custkey AS id FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def missing_ids_anti(spark, d):
    orders = V.table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(orders, "id", "left_anti")


REGISTRY = (("http://*", "insecure"), ("https://*", "secure"), ("*/", "folder"), ("*.html", "file"), ("https://www.*", "www"))


@query(
    "coverage_glob_join",
    "WITH r(pattern, parser) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in REGISTRY) + ") SELECT parser, count(url) AS matched FROM r LEFT JOIN pages ON lower(url) LIKE replace(pattern, '*', '%') GROUP BY parser",
)
def coverage_glob_join(spark, d):
    """One ``*`` to a pattern: a prefix and a suffix. The registry is a fixed list, so it is broadcast."""
    rows = [(*p.split("*"), parser) for p, parser in REGISTRY]
    registry = F.broadcast(spark.createDataFrame(rows, "prefix string, suffix string, parser string"))
    url = F.lower("url")
    pages = V.table(spark, d, "pages").select("url")
    found = pages.join(registry, F.startswith(url, F.col("prefix")) & F.endswith(url, F.col("suffix"))).groupBy("parser").agg(F.count("*").alias("n"))
    return registry.join(found, "parser", "left").select("parser", F.coalesce("n", F.lit(0)).alias("matched"))


@query(
    "shape_target_link",
    """SELECT p_partkey AS shape, count(l.l_orderkey) AS targets, count(DISTINCT l_suppkey) AS suppliers FROM part LEFT JOIN lineitem l ON l_partkey = p_partkey GROUP BY 1""",
)
def shape_target_link(spark, d):
    items = V.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("shape")).agg(F.count("*").alias("t"), F.count_distinct("l_suppkey").alias("s"))
    rows = V.table(spark, d, "part").select(F.col("p_partkey").alias("shape")).join(items, "shape", "left")
    return rows.select("shape", F.coalesce("t", F.lit(0)).alias("targets"), F.coalesce("s", F.lit(0)).alias("suppliers"))


@query(
    "pointer_two_cycles",
    V.sql("""SELECT DISTINCT p.source AS a, p.target AS b, CASE WHEN p.kind <> 'child' AND q.kind <> 'child' THEN 'sibling' WHEN p.kind = 'child' AND q.kind = 'child' THEN 'child' ELSE 'mixed' END AS bucket
        FROM pointers p JOIN pointers q ON q.source = p.target AND q.target = p.source WHERE p.source < p.target""", "pointers"),
)
def pointer_two_cycles(spark, d):
    return directory.cycles_of_two(V.slots(spark, d))


@query(
    "pointer_three_cycles",
    V.sql("""SELECT DISTINCT p.source AS a, q.source AS b, r.source AS c FROM pointers p JOIN pointers q ON q.source = p.target JOIN pointers r ON r.source = q.target AND r.target = p.source
        WHERE p.source < q.source AND p.source < r.source AND q.source <> r.source""", "pointers"),
)
def pointer_three_cycles(spark, d):
    return directory.cycles_of_three(V.slots(spark, d))


@query("reachable_slots", V.sql("+reach AS (SELECT slot FROM slots WHERE slot = 1 UNION SELECT p.target FROM reach r JOIN pointers p ON p.source = r.slot JOIN slots s ON s.slot = p.target) SELECT slot FROM reach", "pointers", recursive=True))
def reachable_slots(spark, d):
    slots = V.slots(spark, d)
    hops = directory.pointer_rows(slots).join(slots.select(F.col("slot").alias("target")), "target", "left_semi")
    return directory.reached(slots.filter("slot = 1").select("slot"), stored(hops.select("source", "target").distinct()), stored)


# Scalar functions

_HOST = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '^(https?|ftp|smb|sftp|file|ldaps?)://', ''), '^.*@', ''), '[/?#\\].*$', ''), ':.*$', ''), '\.+$', '')"""


@query("url_host", f"SELECT page_id, {_HOST} AS host FROM pages")
def url_host(spark, d):
    return V.table(spark, d, "pages").select("page_id", S.url_host(F.col("url")).alias("host"))


@query("url_remote_suspicious", rf"SELECT page_id, regexp_matches(lower(url), '^((https?|ftp|smb|sftp|ldaps?|file)://|\\\\|//)') AS remote, regexp_matches({_HOST}, '\.(ru|cn|tk|ml|ga|cf)$') OR regexp_matches({_HOST}, '^([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}$') OR regexp_matches({_HOST}, '^0x[0-9a-f]+$') OR regexp_matches(lower(url), '^(\\\\|//)') AS suspicious FROM pages")
def url_remote_suspicious(spark, d):
    return V.table(spark, d, "pages").select("page_id", S.is_remote(F.col("url")).alias("remote"), S.is_suspicious_url(F.col("url")).alias("suspicious"))


@query("url_extract", r"""SELECT page_id, unnest(regexp_extract_all('see ' || url || ' (or mailto:a@b.example)', '((?:(?:https?|file|ftp)://|mailto:)[^\s"'')>]+)', 1)) AS found FROM pages""")
def url_extract(spark, d):
    text = F.concat(F.lit("see "), "url", F.lit(" (or mailto:a@b.example)"))
    return V.table(spark, d, "pages").select("page_id", F.explode(S.extract_urls(text)).alias("found"))


@query("short_hash_signature", "SELECT doc_id, left(sha256(text), 16) AS signature FROM documents")
def short_hash_signature(spark, d):
    return V.table(spark, d, "documents").select("doc_id", S.short_hash(F.col("text")).alias("signature"))


@query(
    "column_letter",
    """SELECT p_partkey, CASE WHEN p_partkey < 26 THEN chr(65 + p_partkey) WHEN p_partkey < 702 THEN chr(65 + (p_partkey - 26) // 26) || chr(65 + (p_partkey - 26) % 26)
    ELSE chr(65 + (p_partkey - 702) // 676) || chr(65 + (p_partkey - 702) // 26 % 26) || chr(65 + (p_partkey - 702) % 26) END AS letters FROM (SELECT CAST(p_partkey % 18278 AS INT) AS p_partkey FROM part)""",
)
def column_letter(spark, d):
    rows = V.table(spark, d, "part").select((F.col("p_partkey") % 18278).cast("int").alias("p_partkey"))
    return rows.select("p_partkey", S.column_letter(F.col("p_partkey")).alias("letters"))


@query("filetime_to_timestamp", "SELECT event_id, strftime(make_timestamp((132537600000000000 + event_id * 123456789) // 10 - 11644473600000000), '%Y-%m-%d %H:%M:%S.%f') AS at FROM events")
def filetime_to_timestamp(spark, d):
    at = S.filetime_to_timestamp(F.lit(132_537_600_000_000_000) + F.col("event_id") * 123_456_789)
    return V.table(spark, d, "events").select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


@query("sanitize_and_format", "SELECT p_partkey, regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9._-]', '_', 'g') AS name, CASE WHEN p_retailprice = round(p_retailprice) THEN printf('%.0f', p_retailprice) ELSE printf('%.6f', p_retailprice) END AS price FROM part")
def sanitize_and_format(spark, d):
    return V.table(spark, d, "part").select("p_partkey", S.sanitize_name(F.concat_ws("/", "p_name", "p_brand")).alias("name"), S.format_float(F.col("p_retailprice")).alias("price"))


# Security

_CALLS = " UNION ALL ".join(f"SELECT '{n}' AS name, '{c}' AS category" for n, c in S.SUSPICIOUS_CALLS.items())
_NO_COMMENT = r"NOT regexp_matches(line, '(?i)^\s*(''|rem($|[\s:]))')"
_PROCEDURE = r"regexp_extract(line, '(?i)^\s*(?:(?:private|public|friend|static)\s+)*(?:sub|function)\s+([^\s(]+)', 1)"
_AUTO = "(" + ", ".join(f"'{n.lower()}'" for n in S.AUTO_EXEC) + ")"


@query("vba_procedures", V.sql(rf"SELECT doc_id, line_no, {_PROCEDURE} AS name, lower({_PROCEDURE}) IN {_AUTO} AS auto_exec FROM macros WHERE {_PROCEDURE} <> ''", "macros"))
def vba_procedures(spark, d):
    rows = V.macros(spark, d).withColumn("name", S.vba_procedure(F.col("line"))).filter("name <> ''")
    return rows.select("doc_id", long("line_no", "line_no"), "name", S.is_auto_exec(F.col("name")).alias("auto_exec"))


@query("vba_calls", V.sql(rf"SELECT doc_id, line_no, name, category FROM macros JOIN ({_CALLS}) ON {_NO_COMMENT} AND regexp_matches(line, '(?i)(^|[^A-Za-z0-9_])' || replace(name, '.', '\.') || '([^A-Za-z0-9_]|$)')", "macros"))
def vba_calls(spark, d):
    rows = V.macros(spark, d).select("doc_id", "line_no", F.inline(S.suspicious_calls(F.col("line"))))
    return rows.select("doc_id", long("line_no", "line_no"), "name", "category")


_XLM = " UNION ALL ".join(f"SELECT '{n}' AS name" for n in S.DANGEROUS_XLM)


@query("xlm_dangerous", V.sql(rf"SELECT doc_id, name FROM formulas JOIN ({_XLM}) ON regexp_matches(upper(formula), '(^|[=(,;\s+*/&-])' || replace(name, '.', '\.') || '($|[(,;)\s.!])')", "formulas"))
def xlm_dangerous(spark, d):
    return V.formulas(spark, d).select("doc_id", F.explode(S.dangerous_xlm(F.col("formula"))).alias("name"))


_SUSPICIOUS = rf"""regexp_matches(regexp_replace(upper(formula), '"(?:[^"]|"")*("|$)', ' ', 'g'), '(^|[^A-Z0-9_])({"|".join(S.SUSPICIOUS_FUNCTIONS)})\(')"""


@query("suspicious_formula", V.sql(f"SELECT doc_id, formula, {_SUSPICIOUS} AS suspicious FROM formulas", "formulas"))
def suspicious_formula(spark, d):
    return V.formulas(spark, d).select("doc_id", "formula", S.is_suspicious_formula(F.col("formula")).alias("suspicious"))


@query("formula_function_counts", V.sql(r"SELECT upper(f) AS name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(formula, '([A-Za-z_][A-Za-z0-9_.]*)\(', 1)) AS f FROM formulas) GROUP BY 1", "formulas"))
def formula_function_counts(spark, d):
    return V.formulas(spark, d).select(F.explode(S.formula_functions(F.col("formula"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query(
    "dde_instruction",
    V.sql(r"""+p AS (SELECT doc_id, upper(regexp_extract(formula, '(?i)^\s*(DDEAUTO|DDE)(\s|$)', 1)) AS field_type, list_transform(regexp_extract_all(formula, '"((?:[^"]|"")*)(?:"|$)', 1), lambda x: replace(x, '""', '"')) AS parts FROM formulas),
        q AS (SELECT doc_id, field_type, nullif(parts[1], '') AS a, nullif(parts[2], '') AS t, nullif(parts[3], '') AS i FROM p WHERE field_type <> '')
        SELECT doc_id, field_type, coalesce(a, 'unknown') AS application, CASE WHEN a IS NOT NULL THEN t END AS topic, CASE WHEN a IS NOT NULL THEN i END AS item FROM q""", "formulas"),
)
def dde_instruction(spark, d):
    names = ("field_type", "application", "topic", "item")
    rows = V.formulas(spark, d).select("doc_id", *(c.alias(n) for c, n in zip(S.dde(F.col("formula")), names, strict=True)))
    return rows.filter("field_type <> ''")


_REF = r"""CASE WHEN kind = 'Hyperlink' AND regexp_matches(lower(target), '^(file://|\\\\)') THEN 'Medium' WHEN kind = 'Hyperlink' AND regexp_matches(lower(target), '^((https?|ftp|smb|sftp|ldaps?|file)://|\\\\|//)') THEN 'Low'
    WHEN kind = 'Image' AND regexp_matches(lower(target), '^((https?|ftp|smb|sftp|ldaps?|file)://|\\\\|//)') THEN 'Medium' END"""
_ABSOLUTE = "(SELECT doc_id, kind, regexp_extract(url, '^[a-z]+://[^/]+') || target AS target FROM links WHERE target LIKE '/%')"


@query("external_ref_findings", V.sql(f"SELECT * FROM (SELECT doc_id, kind, target, {_REF} AS severity FROM {_ABSOLUTE}) WHERE severity IS NOT NULL", "links"))
def external_ref_findings(spark, d):
    links = V.links(spark, d).filter("target like '/%'").select("doc_id", "kind", F.concat(F.regexp_extract("url", "^[a-z]+://[^/]+", 0), "target").alias("target"))
    return links.withColumn("severity", security.external_reference_finding(F.col("kind"), F.col("target"))).filter("severity is not null")


_XLM_HITS = rf"(SELECT doc_id, count(*) AS n FROM formulas WHERE EXISTS (SELECT 1 FROM ({_XLM}) x WHERE regexp_matches(upper(formula), '(^|[=(,;\s+*/&-])' || replace(x.name, '.', '\.') || '($|[(,;)\s.!])')) GROUP BY doc_id)"

_SCORE = rf"""+m AS (SELECT doc_id, count(*) AS macros, count(*) FILTER (WHERE lower({_PROCEDURE}) IN {_AUTO}) AS auto_exec FROM macros GROUP BY doc_id),
f AS (SELECT doc_id, count(*) FILTER (WHERE regexp_matches(formula, '(?i)^\s*(DDEAUTO|DDE)(\s|$)')) AS dde, count(*) FILTER (WHERE {_SUSPICIOUS}) AS formulas FROM formulas GROUP BY doc_id), x AS {_XLM_HITS},
r AS (SELECT doc_id, count(*) AS refs FROM links GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS runs, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(regexp_extract_all(text, '[^ \t\r\n\f]+'))) AS BIGINT) AS words FROM paragraphs GROUP BY doc_id),
s AS (SELECT c.*, coalesce(macros, 0) AS macros, coalesce(auto_exec, 0) AS auto_exec, coalesce(dde, 0) AS dde, coalesce(formulas, 0) AS formulas, coalesce(x.n, 0) AS xlm, coalesce(refs, 0) AS refs
  FROM c LEFT JOIN m USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, CASE WHEN macros > 0 OR xlm > 0 THEN 'Critical' WHEN dde > 0 OR formulas > 0 THEN 'High' WHEN refs > 0 THEN 'Medium' ELSE 'None' END AS threat_level FROM s"""


@query("corpus_scorecard", V.sql(_SCORE, "paragraphs", "macros", "formulas", "links"))
def corpus_scorecard(spark, d):
    """One row per document: text statistics, indicator counts and threat level. Each input is aggregated
    by document before the joins, so that all of them share one partitioning."""
    macros = V.macros(spark, d).groupBy("doc_id").agg(F.count("*").alias("macros"), F.count_if(S.is_auto_exec(S.vba_procedure(F.col("line")))).alias("auto_exec"))
    formulas = V.formulas(spark, d).groupBy("doc_id").agg(F.count_if(S.dde(F.col("formula"))[0] != "").alias("dde"), F.count_if(S.is_suspicious_formula(F.col("formula"))).alias("formulas"), F.count_if(F.size(S.dangerous_xlm(F.col("formula"))) > 0).alias("xlm"))
    refs = V.links(spark, d).groupBy("doc_id").agg(F.count("*").alias("refs"))
    rows = reduce(lambda a, b: a.join(b, "doc_id", "left"), (macros, formulas, refs), ir.text_stats(V.paragraphs(spark, d))).na.fill(0)
    none = F.lit(0)
    rank = security.threat_rank(F.col("macros"), F.col("xlm"), F.col("dde"), none, none, F.col("refs"), F.when(F.col("formulas") > 0, F.lit(3)).otherwise(none))
    return rows.withColumn("threat_level", S.severity_label(rank))


_RULES = rf"""
SELECT doc_id, 'SEC-001' AS rule_id, 'Critical' AS severity, 'VBA macro project detected' AS message, CAST(NULL AS BIGINT) AS node_id FROM (SELECT DISTINCT doc_id FROM macros)
UNION ALL SELECT doc_id, 'SEC-002', 'Critical', 'Auto-exec macros: ["' || string_agg(DISTINCT {_PROCEDURE}, '", "' ORDER BY {_PROCEDURE}) || '"]', NULL FROM macros WHERE lower({_PROCEDURE}) IN {_AUTO} GROUP BY doc_id
UNION ALL SELECT doc_id, 'SEC-003', 'High', 'Suspicious VBA call: ' || name, line_no FROM macros JOIN ({_CALLS}) ON {_NO_COMMENT} AND regexp_matches(line, '(?i)(^|[^A-Za-z0-9_])' || replace(name, '.', '\.') || '([^A-Za-z0-9_]|$)')
UNION ALL SELECT doc_id, 'SEC-004', 'High', 'XLM macros detected: ' || n, NULL FROM {_XLM_HITS}
UNION ALL SELECT doc_id, 'SEC-009', 'High', 'DDE field: ' || formula, NULL FROM formulas WHERE regexp_matches(formula, '(?i)^\s*(DDEAUTO|DDE)(\s|$)')
UNION ALL SELECT doc_id, 'SEC-012', 'Medium', 'External links: ' || count(*) || ' (threshold 5)', NULL FROM links WHERE kind = 'Hyperlink' GROUP BY doc_id HAVING count(*) > 5
UNION ALL SELECT doc_id, 'SEC-013', 'High', 'Suspicious formula in A1: ' || formula, NULL FROM formulas WHERE {_SUSPICIOUS}"""


def _findings(spark, d):
    """All rules: macros, formulas and objects are each read in one pass, but for the list of the documents with macros."""
    macros, formulas = V.macros(spark, d), V.formulas(spark, d)
    text, formula, name = F.lit, F.col("formula"), S.vba_procedure(F.col("line"))
    row = lambda rule, message, node: F.struct(F.lit(rule).alias("rule_id"), F.lit(security.RULES[rule]).alias("severity"), message.alias("message"), node.cast("long").alias("node_id"))
    none = F.lit(None)
    calls = F.transform(S.suspicious_calls(F.col("line")), lambda c: row("SEC-003", F.concat(text("Suspicious VBA call: "), c["name"]), F.col("line_no")))
    auto = macros.filter(S.is_auto_exec(name)).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(name)), '", "').alias("names"))  # of a list of fixed names
    cases = F.array_compact(F.array(
        F.when(S.dde(formula)[0] != "", row("SEC-009", F.concat(text("DDE field: "), formula), none)),
        F.when(S.is_suspicious_formula(formula), row("SEC-013", F.concat(text("Suspicious formula in A1: "), formula), none)),
        F.when(F.size(S.dangerous_xlm(formula)) > 0, row("SEC-004", text(""), none)),
    ))
    cells = formulas.select("doc_id", F.inline(cases))
    xlm = cells.filter("rule_id = 'SEC-004'").groupBy("doc_id").count()
    rows = [
        security.finding(macros.select("doc_id").distinct(), "SEC-001", text("VBA macro project detected")),
        security.finding(auto, "SEC-002", F.concat(text('Auto-exec macros: ["'), "names", text('"]'))),
        macros.select("doc_id", F.inline(calls)),
        cells.filter("rule_id <> 'SEC-004'"),
        security.finding(xlm, "SEC-004", F.concat(text("XLM macros detected: "), F.col("count").cast("string"))),
        security.burst(V.links(spark, d).filter("kind = 'Hyperlink'"), "SEC-012", "External links", 5),
        objects.rule_findings(V.objects(spark, d)),
        objects.bursts(V.objects(spark, d), 2, 2),
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)


_RULES += "\nUNION ALL " + V.OBJECT_RULES
_ALL = ("macros", "formulas", "links", "objects")


@query("rules_all_findings", V.sql(_RULES, *_ALL))
def rules_all_findings(spark, d):
    return _findings(spark, d)


@query("rules_with_profile", V.sql(f"SELECT doc_id, rule_id, CASE rule_id WHEN 'SEC-012' THEN 'High' ELSE severity END AS severity, message, node_id FROM ({_RULES}) WHERE rule_id IN ('SEC-001', 'SEC-012', 'STR-001', 'STR-002') AND rule_id <> 'SEC-001'", *_ALL))
def rules_with_profile(spark, d):
    return security.with_profile(_findings(spark, d), ("SEC-001", "SEC-012", "STR-001", "STR-002"), ("SEC-001",), {"SEC-012": "High"})


@query("max_severity_by_rule", V.sql(f"SELECT rule_id, list_extract(['None', 'Low', 'Medium', 'High', 'Critical'], max(CASE severity WHEN 'Critical' THEN 5 WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 2 ELSE 1 END)) AS severity, count(*) AS n, count(DISTINCT doc_id) AS documents FROM ({_RULES}) GROUP BY rule_id", *_ALL))
def max_severity_by_rule(spark, d):
    worst = S.severity_label(F.max(S.severity_rank(F.col("severity"))))
    return _findings(spark, d).groupBy("rule_id").agg(worst.alias("severity"), F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


# Diff


@query(
    "structural_diff",
    V.sql("""SELECT coalesce(l.key, r.key) AS key, CASE WHEN l.key IS NULL THEN 'added' WHEN r.key IS NULL THEN 'removed' ELSE 'modified' END AS change,
        CASE WHEN l.key IS NULL OR r.key IS NULL THEN NULL WHEN l.content_sig IS DISTINCT FROM r.content_sig AND l.style_sig IS DISTINCT FROM r.style_sig THEN 'Both'
          WHEN l.content_sig IS DISTINCT FROM r.content_sig THEN 'Content' WHEN l.style_sig IS DISTINCT FROM r.style_sig THEN 'Style' ELSE 'Metadata' END AS kind, l.summary AS left_summary, r.summary AS right_summary
        FROM snap_left l FULL JOIN snap_right r ON l.key = r.key WHERE l.key IS NULL OR r.key IS NULL OR l.summary IS DISTINCT FROM r.summary""", "snap_left", "snap_right"),
)
def structural_diff(spark, d):
    return diff.diff(*V.snapshots(spark, d))


# Inventory and formulas


@query(
    "inventory_artifacts",
    V.sql("SELECT doc_id, 'macro-module' AS kind, count(*) AS n FROM macros GROUP BY doc_id UNION ALL SELECT doc_id, 'dde-field', 1 FROM formulas WHERE regexp_matches(formula, '(?i)^\\s*(DDEAUTO|DDE)(\\s|$)') UNION ALL SELECT doc_id, lower(kind), count(*) FROM links GROUP BY doc_id, kind", "macros", "formulas", "links"),
)
def inventory_artifacts(spark, d):
    counted = lambda rows, kind: rows.groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("n"))
    fields = V.formulas(spark, d).filter(S.dde(F.col("formula"))[0] != "")
    return counted(V.macros(spark, d), F.lit("macro-module")).unionByName(fields.select("doc_id", F.lit("dde-field").alias("kind"), F.lit(1).cast("long").alias("n"))).unionByName(counted(V.links(spark, d), F.lower("kind")))


@query(
    "indicator_scorecard",
    V.sql(rf"""+t AS (SELECT 'macros' AS key, (SELECT count(DISTINCT doc_id) FROM macros) AS n UNION ALL SELECT 'autoexec', (SELECT count(*) FROM macros WHERE lower({_PROCEDURE}) IN {_AUTO})
        UNION ALL SELECT 'dde', (SELECT count(*) FROM formulas WHERE regexp_matches(formula, '(?i)^\s*(DDEAUTO|DDE)(\s|$)')) UNION ALL SELECT 'activex', 0)
        SELECT key, n, CASE WHEN n > 0 THEN 'present' ELSE 'absent' END AS value FROM t""", "macros", "formulas"),
)
def indicator_scorecard(spark, d):
    macros = V.macros(spark, d)
    one = lambda rows, key, n: rows.agg(n.alias("n")).select(F.lit(key).alias("key"), "n")
    rows = [
        one(macros, "macros", F.count_distinct("doc_id")), one(macros, "autoexec", F.count_if(S.is_auto_exec(S.vba_procedure(F.col("line"))))),
        one(V.formulas(spark, d), "dde", F.count_if(S.dde(F.col("formula"))[0] != "")), one(macros.filter("false"), "activex", F.count("*")),
    ]
    return reduce(lambda a, b: a.unionByName(b), rows).withColumn("value", F.when(F.col("n") > 0, "present").otherwise("absent"))


@query(
    "formula_range_functions",
    """SELECT l_orderkey AS sheet, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS "sum", CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) / count(l_quantity) AS average, min(l_quantity) AS "min", max(l_quantity) AS "max", count(l_quantity) AS "count"
    FROM lineitem WHERE l_linenumber BETWEEN 1 AND 4 GROUP BY 1""",
)
def formula_range_functions(spark, d):
    """SUM, AVERAGE, MIN, MAX and COUNT over the cells of a column range, per sheet."""
    total = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")
    cells = V.table(spark, d, "lineitem").filter("l_linenumber between 1 and 4").groupBy(F.col("l_orderkey").alias("sheet"))
    return cells.agg(total.alias("sum"), (total / F.count("l_quantity")).alias("average"), F.min("l_quantity").alias("min"), F.max("l_quantity").alias("max"), F.count("l_quantity").alias("count"))


@query(
    "sheet_formula_evaluation",
    """WITH cell AS (SELECT l_suppkey, l_quantity AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS r FROM lineitem)
    SELECT l_suppkey AS doc_id, sum(q) FILTER (WHERE r <= 4) * 2 - min(q) FILTER (WHERE r <= 2) AS value FROM cell GROUP BY l_suppkey""",
)
def sheet_formula_evaluation(spark, d):
    """A sheet for each supplier, its quantities in column A, and one formula in B1 that has no value yet."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
    place = F.row_number().over(W.partitionBy("l_suppkey").orderBy(*keys)) - 1
    items = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.lit("s").alias("sheet"), place.alias("row"), F.lit(0).alias("col"), F.col("l_quantity").alias("value"), F.lit(None).cast("string").alias("formula"))
    sheets = items.select("doc_id").distinct()
    cell = sheets.select("doc_id", F.lit("s").alias("sheet"), F.lit(0).alias("row"), F.lit(1).alias("col"), F.lit(None).cast("double").alias("value"), F.lit("=SUM(A1:A4)*2-MIN(A1:A2)").alias("formula"))
    return formula.evaluated(items.unionByName(cell)).select("doc_id", "value")


# Directory and sector statistics


@query("dangling_by_state", V.sql("SELECT f.state || ':' || p.kind AS bucket, count(*) AS n FROM pointers p JOIN slots f ON f.slot = p.source WHERE NOT EXISTS (SELECT 1 FROM slots t WHERE t.slot = p.target) GROUP BY 1", "pointers"))
def dangling_by_state(spark, d):
    slots = V.slots(spark, d)
    dangling = directory.pointer_rows(slots).join(slots.select(F.col("slot").alias("target")), "target", "left_anti")
    rows = dangling.join(slots.select(F.col("slot").alias("source"), "state"), "source")
    return rows.groupBy(F.concat_ws(":", "state", "kind").alias("bucket")).agg(F.count("*").alias("n"))


@query("self_reference_counts", V.sql("SELECT kind AS bucket, count(*) AS n FROM pointers WHERE source = target GROUP BY kind", "pointers"))
def self_reference_counts(spark, d):
    return directory.pointer_rows(V.slots(spark, d)).filter("source = target").groupBy(F.col("kind").alias("bucket")).agg(F.count("*").alias("n"))


@query("incoming_source_type_counts", V.sql("SELECT f.entry_type AS bucket, count(*) AS n FROM pointers p JOIN slots f ON f.slot = p.source JOIN slots t ON t.slot = p.target GROUP BY 1", "pointers"))
def incoming_source_type_counts(spark, d):
    slots = V.slots(spark, d)
    known = directory.pointer_rows(slots).join(slots.select(F.col("slot").alias("target")), "target", "left_semi")
    return known.join(slots.select(F.col("slot").alias("source"), "entry_type"), "source").groupBy(F.col("entry_type").alias("bucket")).agg(F.count("*").alias("n"))


@query("dead_reference_counts", V.sql("SELECT state AS bucket, count(*) AS slots, CAST(sum(refs) AS BIGINT) AS refs FROM incoming WHERE state <> 'normal' AND refs > 0 GROUP BY state", "incoming"))
def dead_reference_counts(spark, d):
    rows = directory.incoming(V.slots(spark, d)).filter("state <> 'normal' and refs > 0")
    return rows.groupBy(F.col("state").alias("bucket")).agg(F.count("*").alias("slots"), F.sum("refs").alias("refs"))


@query(
    "reachability_counts",
    V.sql("""+reach AS (SELECT slot FROM slots WHERE slot = 1 UNION SELECT p.target FROM reach r JOIN pointers p ON p.source = r.slot JOIN slots s ON s.slot = p.target)
        SELECT CASE WHEN state = 'normal' THEN 'live' ELSE 'non-live' END || CASE WHEN r.slot IS NULL THEN ':unreachable' ELSE ':reachable' END AS bucket, count(*) AS n
        FROM slots s LEFT JOIN reach r ON r.slot = s.slot GROUP BY 1""", "pointers", recursive=True),
)
def reachability_counts(spark, d):
    reached = reachable_slots(spark, d).withColumn("reached", F.lit(True))
    live = F.when(F.col("state") == "normal", "live").otherwise("non-live")
    bucket = F.concat(live, F.when(F.col("reached").isNull(), ":unreachable").otherwise(":reachable"))
    return V.slots(spark, d).join(reached, "slot", "left").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "stream_health",
    V.sql("""+n AS (SELECT stream, count(*) AS got, arg_min(sector, CAST(pos AS BIGINT) * 1000000000 + sector) AS start FROM chains GROUP BY stream),
        e AS (SELECT l_orderkey AS stream, CAST(ceil(sum(l_quantity) / 20) AS BIGINT) AS expected FROM lineitem GROUP BY 1),
        sh AS (SELECT sector FROM chains GROUP BY sector HAVING count(DISTINCT stream) > 1), st AS (SELECT start FROM n GROUP BY start HAVING count(*) > 1),
        t AS (SELECT DISTINCT stream FROM chains WHERE sector IN (SELECT sector FROM sh))
        SELECT n.stream, expected, got, got < expected AS truncated, t.stream IS NOT NULL AS shared, st.start IS NOT NULL AS start_reused,
          CASE WHEN t.stream IS NOT NULL THEN 'high' WHEN st.start IS NOT NULL OR got < expected THEN 'medium' ELSE 'none' END AS risk
        FROM n JOIN e USING (stream) LEFT JOIN t ON t.stream = n.stream LEFT JOIN st ON st.start = n.start""", "chains"),
)
def stream_health(spark, d):
    """Expected and found chain length, shared sectors and reused starts, and the risk of each stream."""
    chains = V.chains(spark, d)
    found = chains.groupBy("stream").agg(F.count("*").alias("got"), F.min(F.struct("pos", "sector")).getField("sector").alias("start"))
    expected = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("stream")).agg(F.ceil(F.sum("l_quantity") / 20).cast("long").alias("expected"))
    shared = chains.join(records.shared_sectors(chains, "stream", "sector").select("sector"), "sector", "left_semi").select("stream", F.lit(True).alias("shared")).distinct()
    reused = found.groupBy("start").count().filter("count > 1").select("start", F.lit(True).alias("start_reused"))
    rows = found.join(expected, "stream").join(shared, "stream", "left").join(reused, "start", "left").na.fill(False, ["shared", "start_reused"])
    truncated = F.col("got") < F.col("expected")
    risk = F.when(F.col("shared"), "high").when(F.col("start_reused") | truncated, "medium").otherwise("none")
    return rows.select("stream", "expected", "got", truncated.alias("truncated"), "shared", "start_reused", risk.alias("risk"))


@query("depth_counts", V.sql("SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n, max(depth) OVER () = depth AS deepest FROM (SELECT CASE kind WHEN 'Nation' THEN 1 WHEN 'Customer' THEN 2 ELSE 3 END AS depth FROM tree UNION ALL SELECT 0 FROM (SELECT DISTINCT parent FROM tree WHERE parent LIKE 'R%')) GROUP BY depth", "tree"))
def depth_counts(spark, d):
    """Nodes per depth. The result has a row per level, so the window over it is small."""
    counted = closure_preorder(spark, d).groupBy("depth").agg(F.count("*").alias("n"))
    return counted.select("depth", "n", (F.col("depth") == F.max("depth").over(W.partitionBy(F.lit(0)))).alias("deepest"))


# Set operations


@query(
    "store_merge_last_wins",
    """SELECT id, v FROM (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY source DESC) AS r FROM (
    SELECT p_partkey AS id, p_name AS v, 1 AS source FROM part UNION ALL SELECT p_partkey, p_name || ' v2', 2 FROM part WHERE p_partkey % 3 = 0)) WHERE r = 1""",
)
def store_merge_last_wins(spark, d):
    part = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("v"), F.lit(1).alias("source"))
    later = part.filter("id % 3 = 0").select("id", F.concat("v", F.lit(" v2")).alias("v"), F.lit(2).alias("source"))
    return part.unionAll(later).groupBy("id").agg(F.max_by("v", "source").alias("v"))


@query("style_merge_first_wins", "SELECT p_brand AS style, arg_min(p_name, p_partkey) AS definition, count(*) AS definitions FROM part GROUP BY p_brand")
def style_merge_first_wins(spark, d):
    return V.table(spark, d, "part").groupBy(F.col("p_brand").alias("style")).agg(F.min_by("p_name", "p_partkey").alias("definition"), F.count("*").alias("definitions"))


@query("dedup_paths", r"SELECT DISTINCT lower(regexp_replace(url, '[?#].*$', '')) AS path FROM pages")
def dedup_paths(spark, d):
    return V.table(spark, d, "pages").select(F.lower(F.regexp_replace("url", "[?#].*$", "")).alias("path")).distinct()


@query(
    "duplicate_key_suffix",
    """SELECT p_partkey, p_name || CASE WHEN r = 1 THEN '' ELSE '#' || r END AS key FROM (SELECT p_partkey, p_name, p_brand, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS r FROM part)""",
)
def duplicate_key_suffix(spark, d):
    """Equal keys under one parent: the second is ``key#2`` and so on."""
    place = F.row_number().over(W.partitionBy("p_brand", "p_name").orderBy("p_partkey"))
    return V.table(spark, d, "part").select("p_partkey", F.concat("p_name", F.when(place == 1, "").otherwise(F.concat(F.lit("#"), place.cast("string")))).alias("key"))


@query(
    "worksheet_signature",
    """SELECT l_orderkey AS sheet, left(sha256(string_agg(s, '|' ORDER BY s)), 16) AS signature FROM (
    SELECT l_orderkey, l_linenumber || ':' || l_partkey || '=' || CAST(l_quantity AS BIGINT) AS s FROM lineitem) GROUP BY 1""",
)
def worksheet_signature(spark, d):
    """Sorted cell signatures joined by ``|``, as a short hash; a sheet's cells are gathered together."""
    cell = F.concat(F.col("l_linenumber").cast("string"), F.lit(":"), F.col("l_partkey").cast("string"), F.lit("="), F.col("l_quantity").cast("long").cast("string"))
    rows = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sheet")).agg(F.array_join(F.array_sort(F.collect_list(cell)), "|").alias("s"))
    return rows.select("sheet", S.short_hash(F.col("s")).alias("signature"))


@query("properties_typed", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS value, CASE WHEN json_extract(props, '$.k') IS NULL THEN 'missing' ELSE 'i64' END AS vt FROM events")
def properties_typed(spark, d):
    value = F.get_json_object("props", "$.k").cast("long")
    return V.table(spark, d, "events").select("event_id", value.alias("value"), F.when(value.isNull(), "missing").otherwise("i64").alias("vt"))


@query(
    "conversation_summary",
    r"""SELECT conv_id AS doc_id, count(*) AS sections, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(regexp_extract_all(text, '[^ \t\r\n\f]+'))) AS BIGINT) AS words,
    max(turn) AS last_turn, count(*) FILTER (WHERE role = 'user') AS user_sections FROM conversations GROUP BY conv_id""",
)
def conversation_summary(spark, d):
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\r\n\f]+"), F.lit(0)))
    return V.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.count("*").alias("sections"), F.sum(F.length("text")).alias("chars"), F.sum(words).cast("long").alias("words"), F.max("turn").alias("last_turn"), F.count_if(F.col("role") == "user").alias("user_sections"))


@query(
    "cell_references_parsed",
    r"""WITH r AS (SELECT p_partkey, '$' || chr(CAST(65 + p_partkey % 26 AS INT)) || '$' || (p_size % 9) AS ref FROM part)
    SELECT p_partkey, CASE WHEN CAST(regexp_extract(ref, '([0-9]+)$', 1) AS INT) >= 1 THEN CAST(ascii(regexp_extract(ref, '([A-Z])', 1)) - 65 AS BIGINT) END AS col,
    CASE WHEN CAST(regexp_extract(ref, '([0-9]+)$', 1) AS INT) >= 1 THEN CAST(regexp_extract(ref, '([0-9]+)$', 1) AS BIGINT) - 1 END AS "row" FROM r""",
)
def cell_references_parsed(spark, d):
    """``$`` is allowed, and a row below 1 makes the reference none."""
    ref = F.concat(F.lit("$"), F.chr(F.lit(65) + F.col("p_partkey") % 26), F.lit("$"), (F.col("p_size") % 9).cast("string"))
    row, column = S.cell_ref(ref)
    return V.table(spark, d, "part").select("p_partkey", column.alias("col"), row.alias("row"))


@query(
    "lengths_to_emu",
    "SELECT p_partkey, CAST(round(CASE p_size % 5 WHEN 0 THEN p_size * 360000.0 WHEN 1 THEN p_size * 36000.0 WHEN 2 THEN p_size * 914400.0 WHEN 3 THEN p_size * 12700.0 ELSE p_size * 9525.0 END) AS BIGINT) AS emu FROM part",
)
def lengths_to_emu(spark, d):
    unit = F.element_at(F.array(*(F.lit(u) for u in ("cm", "mm", "in", "pt", "px"))), F.col("p_size") % 5 + 1)
    return V.table(spark, d, "part").select("p_partkey", F.round(S.length_emu(F.concat(F.col("p_size").cast("string"), unit))).cast("long").alias("emu"))


@query(
    "analyzer_levels",
    V.sql(f"""+f AS (SELECT doc_id, max(CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END) AS rank, count(*) AS findings FROM ({_RULES}) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(findings, 0) AS findings, list_extract(['None', 'Low', 'Medium', 'High', 'Critical'], CAST(coalesce(rank, 0) + 1 AS INT)) AS level FROM documents d LEFT JOIN f USING (doc_id)""", *_ALL),
)
def analyzer_levels(spark, d):
    found = _findings(spark, d).groupBy("doc_id").agg(F.max(S.severity_rank(F.col("severity"))).alias("rank"), F.count("*").alias("findings"))
    rows = V.table(spark, d, "documents").select("doc_id").join(found, "doc_id", "left").na.fill(0)
    return rows.select("doc_id", "findings", S.severity_label(F.col("rank")).alias("level"))


from docloom.plans import containers, coverage, formulas, nodes, reports, overview, indicators, packages, trees  # noqa: E402, F401  register their queries beside these
