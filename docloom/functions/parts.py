"""Functions over part names, relationship targets, macro-sheet calls, stream probes and properties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.scalars import looks_external

# Signals, formats, families, extensions and confidence of compound files, first match first.
PROBES = (
    (("FileHeader",), "stream:FileHeader", "hwp", "hangul-word-processor", "hwp", "high"),
    (("WordDocument",), "stream:WordDocument", "doc", "word-processing", "doc", "high"),
    (("Workbook", "Book"), "stream:Workbook", "xls", "spreadsheet", "xls", "high"),
    (("PowerPoint Document",), "stream:PowerPoint Document", "ppt", "presentation", "ppt", "high"),
    (("Current User",), "legacy-office-layout", "office-legacy", "office-legacy", "ole", "medium"),
    (("!_StringData", "!_StringPool"), "stream:!_StringData", "msi", "installer-package", "msi", "medium"),
)
PROBE_ELSE = ("ole", "compound-file", "ole", "medium")
MAIN_FOLDERS = {"WordProcessing": "word/", "Spreadsheet": "xl/", "Presentation": "ppt/"}
CORE_PROPERTIES = {"title": "dc:title", "creator": "dc:creator", "subject": "dc:subject", "keywords": "cp:keywords", "modified": "dcterms:modified"}


def resolved_target(base: Column, target: Column) -> Column:
    """A relationship target as a part name: external ones stay, a leading slash means the package's root, others are
    joined to the folder of ``base``. ``..`` takes a folder off, or stays where there is none; null gives null."""
    plain = F.replace(target, F.lit("\\"), F.lit("/"))
    folder = F.filter(F.split(F.regexp_extract(base, r"(?s)^(.*/)?", 0), "/"), lambda x: x != "")
    up = lambda at: F.when(F.size(at) > 0, F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.array(F.lit("..")))
    step = lambda at, x: F.when(x == "..", up(at)).when(x.isin("", "."), at).otherwise(F.array_append(at, x))
    return F.when(looks_external(target), target).when(plain.startswith("/"), F.substring(plain, 2, 1 << 30)).otherwise(F.array_join(F.aggregate(F.split(plain, "/"), folder, step), "/"))


def call_arguments(formula: Column, name: str) -> Column:
    """What stands between the parentheses of the first call of ``name`` in a formula, whatever the case; parentheses in
    double quotes do not count. Null without a call, or if it is not closed."""
    called = rf"(?is)^.*?(?<![a-z0-9_.$])\Q{name}\E(?![a-z0-9_.$])\s*\((.*)$"
    rest = F.when(formula.rlike(called), F.regexp_extract(formula, called, 1))
    start = F.struct(F.lit(1).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s, c):
        quote, quoted, at = c == '"', s["quoted"], s["at"] + 1
        depth = s["depth"] + F.when(quoted | (s["end"] > 0), 0).when(c == "(", 1).when(c == ")", -1).otherwise(0)
        return F.struct(depth.alias("depth"), (quoted != quote).alias("quoted"), at.alias("at"), F.when((s["end"] == 0) & (depth == 0), at).otherwise(s["end"]).alias("end"))

    end = F.aggregate(F.split(rest, ""), start, step)["end"]
    return F.when(end > 0, F.substring(rest, F.lit(1), end - 1))


def cfb_probe(names: Column) -> Column:
    """(format, family, extension, confidence, signals) of a compound file by the set of its stream names in lower case."""
    out = None
    for streams, signal, *values in PROBES:
        has = F.arrays_overlap(names, F.array(*(F.lit(s.lower()) for s in streams)))
        made = _probe(values, "cfb-signature", signal)
        out = F.when(has, made) if out is None else out.when(has, made)
    return out.otherwise(_probe(PROBE_ELSE, "cfb-signature"))


def _probe(values, *signals) -> Column:
    named = zip(("format", "family", "extension", "confidence"), values, strict=True)
    return F.struct(*(F.lit(v).alias(n) for n, v in named), F.lit(",".join(signals)).alias("signals"))


def main_part_fault(format: Column, path: Column, exists: Column) -> Column:
    """``missing-part``, ``invalid-format`` (outside the format's folder), ``unsupported-format``, or null for none."""
    folder = F.create_map(*(F.lit(x) for kv in MAIN_FOLDERS.items() for x in kv))[format]
    return F.when(~F.coalesce(exists, F.lit(False)), "missing-part").when(folder.isNull(), "unsupported-format").when(~path.startswith(folder), "invalid-format")


def module_status(state: Column, errors: Column, with_source: Column) -> Column:
    """What a macro module's extraction state (and number of errors) is reported as."""
    return (
        F.when(state == "Extracted", F.when(with_source, "extracted").otherwise("recognized")).when(state == "Partial", "partial").when(state == "DecodeFailed", "error")
        .when((state == "MissingStream") & (errors > 0), "partial").otherwise("recognized")
    )


def core_properties(xml: Column) -> list[Column]:
    """Title, creator, subject, keywords and modification time of a core-properties part; null if absent or empty."""
    mark = "\uffff"  # no XML text can hold it, so that one pass over the part gives all of them
    paths = f", '{mark}', ".join(f"/*/*[name()='{tag}']" for tag in CORE_PROPERTIES.values())
    values = F.split(F.xpath_string(xml, F.lit(f"concat({paths})")), mark)
    return [F.nullif(F.get(values, F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(CORE_PROPERTIES)]
