"""Detectors over embedded objects, references and sheets: rules, indicators per format, findings and reports.

``objects`` is (doc_id, node_id, format, node_type, path, name, class_id, prog_id, ref_type, target, linked, hidden,
number), a row for each node that a detector looks at. Each detector reads it once; its cases are columns of one
``CASE`` or elements of one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.operators import security

# Labels of inventory kinds in the export.
EXPORT_KINDS = {
    "ContainerEntry": "container-entry", "RelationshipGraph": "relationship-target", "ExtensionPart": "container-entry", "MediaAsset": "embedded-file",
    "CustomXmlPart": "container-entry", "MacroProject": "vba-project", "MacroModule": "vba-module-source", "OleObject": "ole-object",
    "ActiveXControl": "active-content", "ExternalReference": "relationship-target", "DdeField": "active-content", "Diagnostics": "other",
}
CONTAINERS = {"docx": "zip-ooxml", "xlsx": "zip-ooxml", "pptx": "zip-ooxml", "odt": "zip-odf", "ods": "zip-odf", "odp": "zip-odf", "hwpx": "zip-hwpx", "hwp": "cfb-ole", "rtf": "rtf"}

TYPE = lambda *names: F.col("node_type").isin(*names)


def is_activex_ole() -> Column:
    """An OLE object with a class id, or whose path (else name) says ActiveX."""
    where = F.lower(F.coalesce("path", "name", F.lit("")))
    return F.col("class_id").isNotNull() | where.contains("activex") | where.endswith(".ocx")


def rule_findings(objects: DataFrame) -> DataFrame:
    """SEC-005, SEC-007, SEC-010, SEC-011, STR-001 and STR-002: a finding for each node."""
    unknown = lambda *c: F.coalesce(*c, F.lit("unknown"))
    one = lambda cond, rule, message: F.when(cond, F.struct(F.lit(rule).alias("rule_id"), F.lit(security.RULES[rule]).alias("severity"), message.alias("message")))
    cases = F.array_compact(F.array(
        one(TYPE("OleObject"), "SEC-005", F.concat(F.lit("OLE object: "), unknown("prog_id"))),
        one(TYPE("ActiveXControl"), "SEC-007", F.concat(F.lit("ActiveX control detected: "), unknown("name"))),
        one(TYPE("ExternalReference"), "SEC-010", F.concat(F.lit("External reference: "), "target")),
        one(TYPE("Hyperlink") & S.looks_external(F.col("target")), "SEC-011", F.concat(F.lit("External hyperlink: "), "target")),
        one(TYPE("Worksheet") & F.col("hidden"), "STR-001", F.concat(F.lit("Hidden worksheet: "), F.coalesce("name", F.lit("")))),
        one(TYPE("Slide") & F.col("hidden"), "STR-002", F.concat(F.lit("Hidden slide: "), F.col("number").cast("string"))),
    ))
    return objects.select("doc_id", "node_id", F.inline(cases)).select("doc_id", "rule_id", "severity", "message", "node_id")


def bursts(objects: DataFrame, most_ole: int | None = None, most_activex: int | None = None, most_links: int | None = None) -> DataFrame:
    """SEC-006, SEC-008 and SEC-012: documents with more nodes than a threshold; a rule without one is off."""
    specs = [("SEC-006", "OLE objects", most_ole, TYPE("OleObject")), ("SEC-008", "ActiveX controls", most_activex, TYPE("ActiveXControl")),
             ("SEC-012", "External links", most_links, TYPE("Hyperlink") & S.looks_external(F.col("target")))]
    counted = objects.groupBy("doc_id").agg(*(F.count_if(cond).alias(rule) for rule, _, _, cond in specs))
    row = lambda rule, label, most: F.when(F.col(rule) > most, F.struct(F.lit(rule).alias("rule_id"), F.lit(security.RULES[rule]).alias("severity"), F.concat(F.lit(f"{label}: "), F.col(rule).cast("string"), F.lit(f" (threshold {most})")).alias("message")))
    found = [row(rule, label, most) for rule, label, most, _ in specs if most is not None]
    return counted.select("doc_id", F.inline(F.array_compact(F.array(*found)))).withColumn("node_id", F.lit(None).cast("long"))


def format_indicators(objects: DataFrame) -> DataFrame:
    """(doc_id, indicator, severity, description, location, node_id): what each format's detector reports."""
    where = F.coalesce("path", "name")
    found = lambda text: F.when(where.isNotNull(), F.concat(F.lit(f"{text} at "), where)).otherwise(F.lit(text))
    text, node, none = lambda s: F.lit(s).cast("string"), F.col("node_id"), F.lit(None).cast("long")
    row = lambda kind, severity, description, location, id_: F.struct(F.lit(kind).alias("indicator"), F.lit(severity).alias("severity"), description.alias("description"), location.alias("location"), id_.alias("node_id"))
    ooxml, ole, remote = F.col("format").isin("docx", "xlsx", "pptx"), TYPE("OleObject"), TYPE("ExternalReference") & S.is_remote(F.col("target"))
    embedded = F.lit("Embedded OLE object")
    chosen = (
        F.when(ooxml & ole & is_activex_ole(), row("ActiveXControl", "High", found("ActiveX control binary found"), where, node))
        .when(ooxml & ole, row("OleObject", "High", found("OLE object found"), where, node))
        .when(ooxml & TYPE("ActiveXControl"), row("ActiveXControl", "High", F.when(F.col("path").isNotNull(), F.concat(F.lit("ActiveX control found at "), "path")).otherwise(F.lit("ActiveX control found")), F.col("path"), node))
        .when(~ooxml & remote, row("RemoteResource", "Medium", F.concat(F.lit("Remote resource: "), "target"), F.col("path"), none))
        .when(F.col("format").isin("odt", "ods", "odp") & ole, row("OleObject", "High", embedded, text(None), none))
        .when(F.col("format").isin("hwp", "hwpx") & ole, row("OleObject", "High", embedded, where, node))
        .when((F.col("format") == "rtf") & ole, row("OleObject", "High", embedded, text("rtf"), node))
    )
    return objects.select("doc_id", F.inline(F.array_compact(F.array(chosen))))


def analyzer_findings(objects: DataFrame) -> DataFrame:
    """(doc_id, node_id, kind, severity) of OLE objects (linked or embedded), references and ActiveX controls."""
    severity = (
        F.when(TYPE("OleObject"), F.when(F.col("linked"), "High").otherwise("Medium")).when(TYPE("ActiveXControl"), "High")
        .when(TYPE("ExternalReference"), security.external_reference_finding(F.col("ref_type"), F.col("target")))
    )
    return objects.select("doc_id", "node_id", F.col("node_type").alias("kind"), severity.alias("severity")).filter("severity is not null")


def threat_levels(objects: DataFrame) -> DataFrame:
    """(doc_id, ole, activex, refs, has_content, threat_level): counts and the level they give at least."""
    n = lambda kind: F.count_if(TYPE(kind)).alias(kind)
    counted = objects.groupBy("doc_id").agg(n("OleObject"), n("ActiveXControl"), n("ExternalReference"))
    ole, activex, refs, zero = F.col("OleObject"), F.col("ActiveXControl"), F.col("ExternalReference"), F.lit(0)
    level = S.severity_label(security.threat_rank(zero, zero, zero, ole, activex, refs, zero))
    return counted.select("doc_id", ole.alias("ole"), activex.alias("activex"), refs.alias("refs"), ((ole + activex + refs) > 0).alias("has_content"), level.alias("threat_level"))


def _evidence(objects: DataFrame) -> DataFrame:
    """(doc_id, key, risk, e): five rows for each node, ``e`` what it is evidence of, null if it is none."""
    where = F.coalesce("path", "name")
    native = TYPE("OleObject") & F.coalesce(F.col("path").rlike("(Ole10Native|Package)$"), F.lit(False))
    specs = [
        ("ole-objects", "High", F.when(TYPE("OleObject"), F.coalesce(where, F.col("node_id").cast("string")))),
        ("activex", "High", F.when(TYPE("ActiveXControl"), F.coalesce("path", "name", "prog_id", F.col("node_id").cast("string")))),
        ("external-references", "Medium", F.when(TYPE("ExternalReference"), F.concat_ws(": ", "ref_type", "target"))),
        ("native-payloads", "High", F.when(native, F.coalesce(where, F.col("node_id").cast("string")))),
        ("suspicious-relationships", "Medium", F.when(~F.col("format").isin("docx", "xlsx", "pptx") & TYPE("ExternalReference") & S.is_remote(F.col("target")), F.concat_ws(": ", "path", F.concat(F.lit("Remote resource: "), "target")))),
    ]
    each = F.inline(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(risk).alias("risk"), e.alias("e")) for k, risk, e in specs)))
    return objects.select("doc_id", each)


def evidence(objects: DataFrame) -> DataFrame:
    """(doc_id, key, e): embedded objects, controls, references, native payloads and suspicious relationships."""
    return _evidence(objects).filter("e is not null").select("doc_id", "key", "e")


def scorecard(objects: DataFrame) -> DataFrame:
    """(doc_id, key, value, risk, evidence): of each document the number of finds of each kind, or "absent"."""
    rows = _evidence(objects).groupBy("doc_id", "key", "risk").agg(F.count("e").alias("n"), F.array_join(F.array_sort(F.collect_list("e")), "; ").alias("evidence"))
    present = F.col("n") > 0
    return rows.select("doc_id", "key", F.when(present, F.col("n").cast("string")).otherwise("absent").alias("value"), F.when(present, F.col("risk")).otherwise("None").alias("risk"), "evidence")


def inventory(objects: DataFrame) -> DataFrame:
    """(doc_id, container, kind, export_kind, n) of the kinds that are artifacts."""
    label = F.create_map(*(F.lit(x) for kv in EXPORT_KINDS.items() for x in kv))
    container = F.create_map(*(F.lit(x) for kv in CONTAINERS.items() for x in kv))
    kept = objects.filter(TYPE(*EXPORT_KINDS))
    return kept.groupBy("doc_id", container[F.col("format")].alias("container"), F.col("node_type").alias("kind"), label[F.col("node_type")].alias("export_kind")).agg(F.count("*").alias("n"))


def project_details() -> Column:
    """A macro project as one text, of (name, protected, modules, references, auto_exec, signed)."""
    return F.concat_ws(
        "; ", F.concat(F.lit("name="), F.coalesce("name", F.lit("macro project"))), F.concat(F.lit("protected="), F.col("protected").cast("string")),
        F.concat(F.lit("modules="), F.col("modules").cast("string")), F.concat(F.lit("references="), F.col("references").cast("string")),
        F.when(F.size("auto_exec") > 0, F.concat(F.lit("autoexec="), F.array_join("auto_exec", ","))), F.when(F.col("signed"), "signed=true"),
    )


def manifest(artifacts: DataFrame) -> DataFrame:
    """``artifacts`` (node_id, node_type, path, output, errors) with ``id``, the export's ``kind``, ``status`` (extracted with
    an output, partial with errors, else discovered) and ``path``, where it was found or written."""
    label = F.create_map(*(F.lit(x) for kv in EXPORT_KINDS.items() for x in kv))
    status = F.when(F.col("output").isNotNull(), "extracted").when(F.col("errors") > 0, "partial").otherwise("discovered")
    kind = F.coalesce(F.try_element_at(label, F.col("node_type")), F.lit("other"))
    return artifacts.withColumns({"id": F.col("node_id"), "kind": kind, "status": status, "path": F.coalesce("path", "output", F.lit("unknown"))})


def auto_open(sheets: DataFrame, names: DataFrame, unresolved_marks_all: bool = False) -> DataFrame:
    """``sheets`` (doc_id, node_id, sheet, ...) with ``auto_open``: named by an Auto_Open name's target, whatever the case.

    Where a document has such a name without a target and no sheet was named, its first sheet is marked. With
    ``unresolved_marks_all``, the rule at parse time, all are where none was named.
    """
    own = names.filter(F.upper("name").isin("_XLNM.AUTO_OPEN", "AUTO_OPEN", "AUTO.OPEN"))
    named = own.filter("target is not null").select("doc_id", F.upper("target").alias("u"), F.lit(True).alias("named")).distinct()
    docs = own.groupBy("doc_id").agg(F.bool_or(F.col("target").isNull()).alias("unresolved"))
    rows = sheets.withColumn("u", F.upper("sheet")).join(named, ["doc_id", "u"], "left").join(docs, "doc_id", "left").drop("u")
    per_doc = rows.groupBy("doc_id").agg(F.bool_or(F.coalesce("named", F.lit(False))).alias("any"), F.min("node_id").alias("first"))
    rows = rows.join(per_doc, "doc_id")
    rest = F.col("unresolved").isNotNull() & ~F.col("any") if unresolved_marks_all else F.coalesce("unresolved", F.lit(False)) & ~F.col("any") & (F.col("node_id") == F.col("first"))
    return rows.withColumn("auto_open", F.coalesce("named", F.lit(False)) | rest).drop("named", "unresolved", "any", "first")


def xlm_indicators(marked: DataFrame) -> DataFrame:
    """(doc_id, severity, description, location) of macro sheets: Auto_Open, hidden ones with cells, dangerous functions."""
    row = lambda cond, severity, text: F.when(cond, F.struct(F.lit(severity).alias("severity"), text.alias("description")))
    cases = F.array_compact(F.array(
        row(F.col("auto_open"), "Critical", F.lit("XLM Auto_Open macro detected")),
        row(F.col("hidden") & (F.col("cells") > 0), "High", F.concat(F.lit("Hidden macro sheet: "), "sheet")),
        row(F.col("function").isNotNull(), "Critical", F.concat(F.lit("XLM macro function "), "function", F.lit(" at A1"))),
    ))
    return marked.select("doc_id", F.col("path").alias("location"), F.inline(cases))
