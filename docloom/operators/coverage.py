"""Coverage of package parts: content types, a registry of known parts, and what neither names.

``parts`` is (doc_id, path, seen). The registry and the content types are lists of a document format's specification, so
they are broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import scalars as S


def counted_parts(parts: DataFrame) -> DataFrame:
    """Without folders and trash."""
    return parts.filter(~F.col("path").endswith("/") & ~F.col("path").startswith("[trash]/"))


def with_content_type(parts: DataFrame, overrides: dict[str, str], defaults: dict[str, str]) -> DataFrame:
    """``content_type``: that of the path, else of its extension, else null; case does not matter."""
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    path = F.lower(F.regexp_replace("path", "^/", ""))
    return parts.withColumn("content_type", F.coalesce(F.try_element_at(table(overrides), path), F.try_element_at(table(defaults), S.extension(path))))


def _folder(head: Column) -> Column:
    return F.concat(F.regexp_extract(head, "^(.*/)?", 0), F.lit("*"))


def keyed(parts: DataFrame, alone: bool = False, depths: list[int] | None = None) -> DataFrame:
    """``parts`` with ``_path``, the path in small letters, and ``key``: a row for the path, and one for each folder it lies in (if
    ``depths`` is given, those of these depths) with a ``*``, what a pattern that matches it has as its key; if ``alone`` also one
    without a key."""
    path, n = F.col("_path"), F.col("_n")
    rows = parts.withColumn("_path", F.lower("path")).withColumn("_depth", F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))))
    further = [-1, *([-2] if alone else [])]  # the path, no key
    steps = lambda ns: F.array(*(F.lit(i) for i in (*ns, *further)))
    if depths is None:
        folders = F.concat(F.sequence(F.lit(0), "_depth"), steps([]))
    else:
        ds = sorted(depths)
        folders = reduce(lambda found, i: F.when(F.col("_depth") >= ds[i], steps(ds[: i + 1])).otherwise(found), range(len(ds)), steps([]))
    own = F.when(F.substring_index(path, "/", -1) != "*", path)  # else it is the key of its folder
    key = F.when(n == -1, own).when(n == 0, "*").when(n > 0, F.concat(F.call_function("substring_index", path, F.lit("/"), n), F.lit("/*")))
    return rows.withColumn("_n", F.explode(folders)).withColumn("key", key).filter(F.col("key").isNotNull() | (n == -2)).drop("_n", "_depth")


def specified(registry: DataFrame) -> DataFrame:
    """``registry`` with the literal head and tail of each pattern and its key: the whole pattern, or the folder of its head."""
    star = F.contains("pattern", F.lit("*"))
    head, tail = (F.lower(F.split_part("pattern", F.lit("*"), F.lit(i))) for i in (1, 2))
    return registry.select("*", head.alias("head"), F.when(star, tail).alias("tail"), F.when(star, _folder(head)).otherwise(F.lower("pattern")).alias("key"))


def matched(parts: DataFrame, registry: DataFrame) -> DataFrame:
    """Each part with each pattern of ``registry`` (pattern, expected, parser) that it matches, and its status.

    A pattern has one ``*`` at most. If both content types are known they must be equal. Parts meet only the patterns of
    their own name and folders. Where both tables have a ``format``, it must be the same.
    """
    further = [c for c in ("format", "spec") if c in registry.columns]
    return _met(parts, registry, "inner").select("doc_id", "ord", "path", "pattern", "parser", "content_type", F.when(F.col("seen"), "complete").otherwise("pending").alias("status"), *further)


def _met(parts: DataFrame, registry: DataFrame, how: str, depths: list[int] | None = None) -> DataFrame:
    """Each part with each pattern that it matches; if ``how`` is ``left`` also each part once without any (null pattern). ``depths``
    are those of the folders that ``registry`` has as keys, if they are known."""
    on = ["key", "format"] if "format" in parts.columns and "format" in registry.columns else ["key"]
    path, known = F.col("p._path"), specified(registry)
    alike = F.when(F.col("k.tail").isNull(), path == F.col("k.head")).otherwise(path.startswith(F.col("k.head")) & path.endswith(F.col("k.tail")) & (F.length(path) >= F.length("k.head") + F.length("k.tail")))
    fits = F.col("k.expected").isNull() | F.col("p.content_type").isNull() | (F.col("k.expected") == F.col("p.content_type"))
    same = reduce(lambda a, b: a & b, (F.col(f"p.{c}") == F.col(f"k.{c}") for c in on))
    rows = keyed(parts, how == "left", depths).alias("p").join(F.broadcast(known).alias("k"), same & alike & fits, how)
    met = rows.select("p.*", *(F.col(f"k.{c}") for c in registry.columns if c not in parts.columns))
    return met.filter("key is null or pattern is not null").drop("key", "_path")


def counts(parts: DataFrame, registry: DataFrame, patterns: int) -> DataFrame:
    """(doc_id, matched, complete, pending, missing, unknown) of each document."""
    found = matched(parts, registry).groupBy("doc_id").agg(F.count("*").alias("matched"), F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_distinct("pattern").alias("patterns"))
    unknown = parts.groupBy("doc_id").agg(F.count_if(F.col("content_type").isNull()).alias("unknown"))
    rows = unknown.join(found, "doc_id", "left").na.fill(0)
    return rows.select("doc_id", "matched", "complete", "pending", (F.lit(patterns) - F.col("patterns")).alias("missing"), "unknown")


def missing(parts: DataFrame, registry: DataFrame) -> DataFrame:
    """Patterns that no part of any document matches."""
    return registry.join(matched(parts, registry).select("pattern").distinct(), "pattern", "left_anti").select("pattern", "parser")


def unparsed(parts: DataFrame, known: DataFrame) -> DataFrame:
    """Paths of each document that ``known`` (doc_id, path) lacks."""
    return parts.select("doc_id", "path").distinct().join(known, ["doc_id", "path"], "left_anti")


# Reports

#: Patterns to a word of a document's set of those that it has.
_BITS = 63
#: The sections of a report as CSV, and of one as text with their titles, in their orders.
SECTIONS = ("parts", "part_rows", "missing", "inventory", "unknown", "histogram", "summary")
TITLES = {"parts": "Matched Parts", "missing": "Missing Patterns", "inventory": "Content Types Inventory", "histogram": "Content Type Histogram", "unknown": "Unknown Content Types"}
#: The sections whose entries follow from parts, with the number of a document's entries.
_ITEMS = {"parts": "matched", "inventory": "typed", "unknown": "unknown", "histogram": "kinds"}
_CODES = {s: i for i, s in enumerate(_ITEMS)}
HEADER = "section,code,severity,message,path"
_text = lambda *cs: F.concat(*(F.lit(c) if not isinstance(c, Column) else c.cast("string") for c in cs))
_is = lambda s: F.col("section") == _CODES[s]
_long = lambda n: F.lit(n).cast("long")


class Report:
    """The report of each document, from ``parts`` (doc_id, format, ord, path, seen, content_type; a document has one format) and
    ``registry``, which has ``format`` and ``spec``, the order of its patterns.

    A document's entries are sorted and counted where its parts lie: parts dealt by document are dealt once, and one document is
    one task's (a package has 10,000 entries at most, see ``containers``; more spill). The patterns that it lacks are met last, in a
    broadcast join with lines made once for each pattern.
    """

    def __init__(self, parts: DataFrame, registry: DataFrame):
        place = F.row_number().over(W.partitionBy("format").orderBy("spec")) - 1  # of a list that is fixed
        registry = registry.withColumn("_place", place)
        key = F.col("key")
        depth = F.when(F.col("tail").isNotNull(), F.length(key) - F.length(F.replace(key, F.lit("/"), F.lit(""))))
        last, depths = specified(registry).agg(F.max("_place"), F.collect_set(depth)).first()
        self.words = range((last or 0) // _BITS + 1)
        bit = F.call_function("shiftleft", _long(1), (F.col("_place") % _BITS).cast("int"))
        #: With ``set0``, ``set1``, ...: the bit of a pattern in a document's words.
        self.registry = registry.withColumns({f"set{i}": F.when(F.floor(F.col("_place") / _BITS) == i, bit).otherwise(_long(0)) for i in self.words}).drop("_place")
        self.sizes = registry.groupBy("format").agg(F.count("*").alias("listed"))
        #: Each part once by itself, and once with each pattern that it matches.
        self.met = _met(parts, self.registry, "left", depths).withColumns({"hit": F.col("spec").isNotNull(), "seen": F.coalesce("seen", F.lit(False))})

    def _lacks(self, docs: DataFrame) -> DataFrame:
        """``docs`` (format, has0, has1, ..., null for none) with ``lacks``, the number of patterns that each lacks."""
        docs = docs.withColumns({f"has{i}": F.coalesce(f"has{i}", _long(0)) for i in self.words})
        has = reduce(lambda a, b: a + b, (F.bit_count(f"has{i}") for i in self.words))
        return docs.join(F.broadcast(self.sizes), "format", "left").withColumn("lacks", F.coalesce("listed", _long(0)) - has).drop("listed")

    def docs(self) -> DataFrame:
        """(doc_id, format, matched, done, unknown, has0, ..., lacks) of each document."""
        own = ~F.col("hit")
        found = self.met.groupBy("doc_id", "format").agg(
            F.count_if("hit").alias("matched"), F.count_if(F.col("hit") & F.col("seen")).alias("done"), F.count_if(own & F.col("content_type").isNull()).alias("unknown"),
            *(F.bit_or(f"set{i}").alias(f"has{i}") for i in self.words),
        )
        return self._lacks(found)

    def lacking(self, docs: DataFrame, *order) -> DataFrame:
        """Each of ``docs`` with each pattern that it lacks, and ``nth``, the 1-based place of that in ``order`` among those that it lacks."""
        before = W.partitionBy("format").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        listed = self.registry.withColumns({f"ahead{i}": F.coalesce(F.bit_or(f"set{i}").over(before), _long(0)) for i in self.words})
        listed = listed.withColumns({"said": _lack(F.col("pattern"), F.col("parser")), "csv": _csv("missing,COVERAGE_MISSING,Warning,", _lack(F.col("pattern"), F.col("parser")), F.col("pattern"))})
        unset = reduce(lambda a, b: a & b, (F.col(f"has{i}").bitwiseAND(F.col(f"set{i}")) == 0 for i in self.words))
        rows = docs.join(F.broadcast(listed.withColumnRenamed("format", "_format")), (F.col("format") == F.col("_format")) & unset)
        return rows.withColumn("nth", reduce(lambda a, b: a + b, (F.bit_count(F.col(f"ahead{i}").bitwiseAND(F.bitwise_not(f"has{i}"))) for i in self.words)) + _long(1))

    def lacks(self) -> DataFrame:
        """(doc_id, spec, pattern, message) of each pattern that a document lacks."""
        return self.lacking(self.docs(), "spec").select("doc_id", F.col("spec").cast("long").alias("spec"), "pattern", F.col("said").alias("message"))

    def summaries(self) -> DataFrame:
        """(doc_id, message) of each document."""
        return self.docs().select("doc_id", _summary().alias("message"))

    def placed(self, starts: dict[str, Column], order: list[str], store, names: DataFrame | None = None) -> DataFrame:
        """What parts give, as (doc_id, format, section, line_no, shown, content_type, parser, complete, n, first, matched): a row for each
        part, match and content type, written by ``store``. ``starts`` are the lines ahead of each section's entries, by the numbers of
        the document; entries are in the order of ``order``, of ``k1`` (pattern and place of a match) and ``shown`` (path or content
        type). The first row of a document has its numbers, null elsewhere, but for ``matched`` of matches; with ``names`` also theirs.
        """
        hit, typed, histogram = F.col("hit"), F.col("content_type").isNotNull(), _is("histogram")
        codes = lambda *names: F.array(*(F.lit(_CODES[s]) for s in names))
        rows = self.met.withColumn("section", F.explode(F.when(hit, codes("parts")).when(typed, codes("inventory", "histogram")).otherwise(codes("unknown"))))
        rank = F.get(F.array(*(F.lit([*starts].index(s)) for s in _ITEMS)), F.col("section"))
        rows = rows.select(
            "doc_id", "format", "section", rank.alias("_rank"), F.when(hit, F.col("spec").cast("long") * (1 << 32) + F.col("ord")).otherwise(0).alias("k1"), F.when(histogram, F.col("content_type")).otherwise(F.col("path")).alias("shown"),
            F.when(~histogram, F.col("content_type")).alias("content_type"), "parser", (hit & F.col("seen")).alias("complete"), *(f"set{i}" for i in self.words),
        )
        if names is not None:
            rows = rows.join(names.withColumn("named", F.lit(True)), "doc_id", "left")
        by = W.partitionBy("doc_id").orderBy("_rank", *order)
        again = F.lead("_rank").over(by).eqNullSafe(F.col("_rank")) & F.lead("shown").over(by).eqNullSafe(F.col("shown"))
        rows = rows.withColumns({"n": (F.row_number().over(by) - F.rank().over(by) + 1).cast("long"), "_again": again}).filter(~histogram | ~F.col("_again"))  # a content type once, with its count
        whole = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        numbers = {n: F.count_if(_is(s)).over(whole) for s, n in _ITEMS.items()} | {"done": F.count_if("complete").over(whole)} | {f"has{i}": F.bit_or(f"set{i}").over(whole) for i in self.words}
        rows = self._lacks(rows.withColumns({"_at": F.row_number().over(by).cast("long"), **numbers}))
        line_no, ahead = F.lit(None).cast("long"), _long(0)
        for section in starts:
            if section in _ITEMS:
                line_no = F.when(_is(section), starts[section] - ahead + F.col("_at")).otherwise(line_no)
                ahead = ahead + F.col(_ITEMS[section])
        first = F.col("_at") == 1
        once = [n for n in (*numbers, "lacks", *(names.columns if names is not None else ()), *(["named"] if names is not None else ())) if n not in ("matched", "doc_id")]
        return store(
            rows.select(
                "doc_id", "format", "section", line_no.alias("line_no"), "shown", "content_type", "parser", "complete", "n", first.alias("first"),
                F.when(first | _is("parts"), F.col("matched")).alias("matched"), *(F.when(first, F.col(c)).alias(c) for c in once),
            )
        )


def _lack(pattern: Column, parser: Column) -> Column:
    return _text("missing part for pattern ", pattern, " (expected parser=", parser, ")")


def _counts() -> Column:
    return _text("complete=", F.col("done"), ", pending=", F.col("matched") - F.col("done"), ", missing_patterns=", F.col("lacks"), ", unknown_content_types=", F.col("unknown"))


def _summary() -> Column:
    return _text("coverage summary: matched=", F.col("matched"), ", ", _counts())


def _said() -> Column:
    """The message of an item."""
    shown, kind = F.col("shown"), F.col("content_type")
    part = _text(F.when(F.col("complete"), "complete").otherwise("pending"), " part: ", shown, " (content-type=", F.coalesce(kind, F.lit("unknown")), ", parser=", F.col("parser"), ")")
    return F.when(_is("parts"), part).when(_is("inventory"), _text("content-type: ", shown, " => ", kind)).when(_is("unknown"), _text("no content-type entry for path ", shown)).otherwise(_text("content-type-count: ", shown, " => ", F.col("n")))


def csv_field(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    special = reduce(lambda a, b: a | b, (F.contains(value, F.lit(c)) for c in ',"\n\r'))
    return F.when(special, quoted).otherwise(F.coalesce(value, F.lit("")))


def _csv(head: Column | str, message: Column, path: Column) -> Column:
    return _text(head, csv_field(message), ",", csv_field(path))


def csv_lines(report: Report, store) -> DataFrame:
    """(doc_id, line_no, line): each document's report as CSV, line 0 its header."""
    col, lit = F.col, F.lit
    sizes, starts, at = {**_ITEMS, "part_rows": "matched", "missing": "lacks"}, {}, _long(0)
    for section in SECTIONS:
        starts[section] = at
        at = at + col(sizes[section]) if section in sizes else at
    placed = report.placed(starts, ["k1", "shown"], store)
    # A row's lines: 0 its own, 1 a match's row, and of a document's first row 2 the header, 3 the summary.
    kinds = lambda *ks: F.array(*map(lit, ks))
    each, first, part = col("kind"), col("first"), _is("parts")
    rows = placed.withColumn("kind", F.explode(F.when(first & part, kinds(0, 1, 2, 3)).when(part, kinds(0, 1)).when(first, kinds(0, 2, 3)).otherwise(kinds(0))))
    no = F.when(each == 0, col("line_no")).when(each == 1, col("line_no") + col("matched")).when(each == 2, _long(0)).otherwise(starts["summary"] + 1)
    heads = {"inventory": "inventory,CONTENT_TYPE_INVENTORY,Info,", "unknown": "unknown,CONTENT_TYPE_UNKNOWN,Warning,", "histogram": "histogram,CONTENT_TYPE_HISTOGRAM,Info,"}
    head = F.when(each == 1, "part_rows,COVERAGE_PART_ROW,Info,").when(each == 3, "summary,COVERAGE_SUMMARY,Info,").when(part & col("complete"), "parts,COVERAGE_PART,Info,").when(part, "parts,COVERAGE_PART,Warning,")
    head = head.when(_is("inventory"), heads["inventory"]).when(_is("unknown"), heads["unknown"]).otherwise(heads["histogram"])
    rows = rows.select("doc_id", no.alias("line_no"), "kind", head.alias("head"), F.when(each == 3, _summary()).when(each < 2, _said()).alias("message"), F.when(each < 2, col("shown")).alias("shown"))
    body = rows.select("doc_id", "line_no", F.when(each == 2, HEADER).otherwise(_csv(col("head"), col("message"), col("shown"))).alias("line"))
    gone = report.lacking(placed.filter("first"), "spec").select("doc_id", (starts["missing"] + col("nth")).alias("line_no"), col("csv").alias("line"))
    return body.unionByName(gone)


def parts_csv(found: DataFrame) -> DataFrame:
    """(doc_id, spec, ord, line): the matched parts as CSV lines of status, path, content type and reader."""
    status, path, kind, parser = (csv_field(F.coalesce(c, F.lit("unknown"))) for c in ("status", "path", "content_type", "parser"))
    comma = F.lit(",")
    return found.select("doc_id", "spec", "ord", F.concat(status, comma, path, comma, kind, comma, parser).alias("line"))


def text_lines(report: Report, names: DataFrame | tuple[Column, Column], store) -> DataFrame:
    """(doc_id, line_no, line): each document's report as text. ``names`` is (doc_id, file, display), or file and display as columns of
    (doc_id, format). Sections without entries are left out; the entries of one are in the order of their paths."""
    col, lit = F.col, F.lit
    joined = isinstance(names, DataFrame)
    sizes, starts, sums = {**_ITEMS, "missing": "lacks"}, {}, F.when(col("named"), _long(6)).otherwise(0) if joined else _long(6)
    at = sums + 3
    for section in TITLES:
        starts[section] = at + 2  # a blank line and the title are ahead
        at = at + F.when(col(sizes[section]) > 0, col(sizes[section]) + 2).otherwise(0)
    placed = report.placed(starts, ["shown", "k1"], store, names if joined else None)
    if not joined:
        placed = placed.withColumns({"file": names[0], "display": names[1]})
    body = placed.select("doc_id", "line_no", _text("  ", _said()).alias("line"))
    docs = placed.filter("first")
    # A document's further lines by their kinds: 0 to 5 its names, 6 to 8 its numbers, then a blank line and a title for each section.
    kind, top, blanks = col("kind"), ["Coverage Report", "===============", "", None, None, ""], [None] * 3
    fixed = [*top, *blanks, *(x for title in TITLES.values() for x in ("", title + ":"))]
    named = lambda n: F.when(n == 3, F.concat(lit("File: "), "file")).when(n == 4, F.concat(lit("Format: "), "display"))
    at = F.get("titles", F.floor((kind - 9) / 2).cast("int")) - kind % 2
    rows = docs.select(
        "doc_id", "file", "display", sums.alias("sums"), _summary().alias("summary"), _counts().alias("counts"),
        F.array(*(F.when(col(sizes[s]) > 0, starts[s]) for s in TITLES)).alias("titles"), F.explode(F.array(*map(lit, range(len(fixed))))).alias("kind"),
    )
    no = F.when(kind < 6, F.when(kind < col("sums"), kind.cast("long") + 1)).when(kind < 9, col("sums") + kind - 5).otherwise(at)
    said = named(kind).when(kind == 6, col("summary")).when(kind == 7, F.concat(lit("counts: "), "counts")).when(kind == 8, F.concat(lit("parts: "), "counts")).otherwise(F.get(F.array(*map(lit, fixed)), kind))
    body = body.unionByName(rows.select("doc_id", no.alias("line_no"), said.alias("line")).filter("line_no is not null"))
    missing = report.lacking(docs, F.coalesce("pattern", lit("")), "spec")
    body = body.unionByName(missing.select("doc_id", (starts["missing"] + col("nth")).alias("line_no"), F.concat(lit("  "), "said").alias("line")))
    if not joined:
        return body
    alone = names.join(docs.select("doc_id"), "doc_id", "left_anti").select("doc_id", "file", "display", F.explode(F.array(*map(lit, range(len(top))))).alias("kind"))
    return body.unionByName(alone.select("doc_id", (kind + 1).cast("long").alias("line_no"), named(kind).otherwise(F.get(F.array(*map(lit, top)), kind)).alias("line")))
