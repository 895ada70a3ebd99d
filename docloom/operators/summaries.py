"""One-line summaries, keys and signatures of nodes, rendered from templates, and path keys of whole trees.

``nodes`` is (doc_id, node_id, node_type, attrs: map<string, string>). Counts, flags and ids are attributes too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.operators.ranks import ranked
from docloom.storage import stored

# A field is {attr}, a dash if it is missing; {a|b} the first that is there; {attr=x} x if it is missing;
# {attr!} makes the whole text null if it is missing; {attr~80} keeps 80 characters and an ellipsis.
# The line of each type of node.
SUMMARIES = {
    "Document": "format={format} content_nodes={content=0} macros={macros=false} ole={ole=0} external_refs={external_refs=0} threat={threat=None}",
    "Section": "name={name} content_nodes={content=0} columns={columns=1} orientation={orientation=None}",
    "Paragraph": 'style={style_id} runs={runs=0} text="{text=~80}"',
    "Run": 'text="{text=~80}" bold={bold} italic={italic} size={size}',
    "Hyperlink": 'target={target} external={external=false} runs={runs=0} text="{text=~80}"',
    "Table": "rows={rows=0} cols={cols=0} style={style_id}",
    "TableRow": "cells={cells=0}",
    "TableCell": "content_nodes={content=0} span={span=1}",
    "MacroProject": "name={name} modules={modules=0} auto_exec={auto_exec=false} protected={protected=false}",
    "MacroModule": "name={name} module_type={module_type} suspicious_calls={suspicious_calls=0}",
    "OleObject": "name={name} prog_id={prog_id} linked={linked=false} size={size=0} hash={hash}",
    "ExternalReference": "type={type} target={target}",
    "ActiveXControl": "name={name} clsid={clsid} prog_id={prog_id}",
    "Metadata": "title={title} author={creator}",
    "Theme": "name={name} colors={colors=0} fonts={major_font}",
    "MediaAsset": "path={path} type={type} size={size=0}",
    "CustomXmlPart": "path={path} root={root}",
    "RelationshipGraph": "source={source} rels={rels=0}",
    "DigitalSignature": "id={id} method={method}",
    "ExtensionPart": "path={path} kind={kind} size={size=0}",
    "StyleSet": "styles={styles=0}",
    "NumberingSet": "abstracts={abstracts=0} nums={nums=0}",
    "Comment": "id={id} author={author} content_nodes={content=0}",
    "Footnote": "id={id} content_nodes={content=0}",
    "Endnote": "id={id} content_nodes={content=0}",
    "Header": "content_nodes={content=0}",
    "Footer": "content_nodes={content=0}",
    "WordSettings": "entries={entries=0}",
    "WebSettings": "entries={entries=0}",
    "FontTable": "fonts={fonts=0}",
    "ContentControl": "content_nodes={content=0} tag={tag}",
    "BookmarkStart": "id={id} name={name}",
    "BookmarkEnd": "id={id}",
    "Field": "runs={runs=0} instr={instruction}",
    "Revision": "type={type} content_nodes={content=0}",
    "Worksheet": "name={name} sheet_id={sheet_id=0} state={state=Visible} cells={cells=0} merged={merged=0}",
    "SharedStringTable": "items={items=0}",
    "ConnectionPart": "connections={entries=0}",
    "SpreadsheetStyles": "numfmts={numfmts=0} fonts={fonts=0} fills={fills=0} borders={borders=0} xfs={xfs=0} style_xfs={style_xfs=0} dxfs={dxfs=0} table_styles={table_style}",
    "DefinedName": "name={name} scope={scope=global}",
    "ConditionalFormat": "ranges={ranges=0} rules={rules=0}",
    "DataValidation": "ranges={ranges=0} type={type}",
    "TableDefinition": "name={display_name} cols={cols=0} ref={ref}",
    "PivotTable": "name={name} cache_id={cache_id}",
    "PivotCache": "cache_id={cache_id=0} source={source}",
    "PivotCacheRecords": "records={records=0} fields={fields=0}",
    "WorkbookProperties": "calc_mode={calc_mode} protected={protected=false}",
    "CalcChain": "entries={entries=0}",
    "SheetComment": "cell_ref={ref} author={author} text={text=~80}",
    "SheetMetadata": "types={types=0} cell_count={cell_count} value_count={value_count}",
    "WorksheetDrawing": "shapes={shapes=0}",
    "ChartData": "type={type} series={series=0} series_data={series_data=0}",
    "ExternalLinkPart": "type={type} target={target} sheets={sheets=0}",
    "SlicerPart": "name={name} caption={caption} cache_id={cache_id}",
    "TimelinePart": "name={name} cache_id={cache_id}",
    "QueryTablePart": "name={name} connection_id={connection_id} url={url}",
    "Slide": "number={number=0} name={name} shapes={shapes=0} hidden={hidden=false}",
    "Shape": 'type={type} name={name} text="{text=~80}" x={x=0} y={y=0} w={w=0} h={h=0} link={link}',
    "SlideMaster": "shapes={shapes=0} layouts={layouts=0}",
    "SlideLayout": "shapes={shapes=0}",
    "NotesMaster": "shapes={shapes=0}",
    "HandoutMaster": "shapes={shapes=0}",
    "NotesSlide": "shapes={shapes=0} text={text}",
    "PresentationProperties": "auto_compress={auto_compress} compat={compat} rtl={rtl}",
    "ViewProperties": "last_view={last_view} zoom={zoom}",
    "TableStyleSet": "default={default} styles={styles=0}",
    "PptxCommentAuthor": "author_id={author_id=0} name={name}",
    "PptxComment": "author_id={author_id} text={text=~80}",
    "PresentationTag": "name={name} value={value}",
    "PresentationInfo": "slide_size={slide_size} notes_size={notes_size} show_type={show_type}",
    "CommentExtensionSet": "entries={entries=0}",
    "CommentIdMap": "mappings={mappings=0}",
    "CommentRangeStart": "comment_id={comment_id}",
    "CommentRangeEnd": "comment_id={comment_id}",
    "CommentReference": "comment_id={comment_id}",
    "PeoplePart": "people={people=0}",
    "SmartArtPart": "kind={kind} path={path}",
    "WebExtension": "id={id} store={store} version={version} properties={properties=0}",
    "WebExtensionTaskpane": "ref={ref} dock_state={dock_state} visible={visible}",
    "GlossaryDocument": "entries={entries=0}",
    "GlossaryEntry": "name={name} gallery={gallery} content_nodes={content=0}",
    "VmlDrawing": "path={path} shapes={shapes=0}",
    "VmlShape": "name={name} rel_id={rel_id} image_target={image_target}",
    "DrawingPart": "path={path} shapes={shapes=0}",
    "Diagnostics": "entries={entries=0}",
}
# The attribute that names a node among its siblings.
KEYED_BY = {
    "Worksheet": "{name}", "Cell": "{ref}", "DefinedName": "{name}", "TableDefinition": "{display_name!}", "PivotTable": "{name!}", "SheetComment": "{ref}", "ExternalLinkPart": "{target}",
    "ConnectionPart": "{entries=0}", "SlicerPart": "{name}", "TimelinePart": "{name}", "QueryTablePart": "{name}", "PivotCache": "{cache_id=0}", "PivotCacheRecords": "{records=0}",
    "Hyperlink": "{target}", "StyleSet": "{styles=0}", "NumberingSet": "{abstracts=0}", "Comment": "{id}", "Footnote": "{id}", "Endnote": "{id}", "BookmarkStart": "{id}", "BookmarkEnd": "{id}",
    "Field": "{instruction}", "Revision": "{type}", "CommentRangeStart": "{comment_id}", "CommentRangeEnd": "{comment_id}", "CommentReference": "{comment_id}", "GlossaryEntry": "{name}",
    "VmlDrawing": "{path}", "VmlShape": "{name}", "DrawingPart": "{path}", "Slide": "{number=0}", "Shape": "{name!}", "PptxCommentAuthor": "{author_id=0}", "PresentationTag": "{name}",
    "SmartArtPart": "{kind}", "ExternalReference": "{target}", "ActiveXControl": "{prog_id!}", "MacroModule": "{name}", "MacroProject": "{name!}", "OleObject": "{name|prog_id!}",
    "WebExtension": "{id}", "WebExtensionTaskpane": "{ref}",
}
# Types whose key is the type alone.
SINGLE = (
    "WorksheetDrawing", "CalcChain", "SheetMetadata", "SharedStringTable", "SpreadsheetStyles", "ConditionalFormat", "DataValidation", "WorkbookProperties", "Header", "Footer", "WordSettings",
    "WebSettings", "FontTable", "ContentControl", "CommentExtensionSet", "CommentIdMap", "GlossaryDocument", "SlideMaster", "SlideLayout", "NotesMaster", "HandoutMaster", "NotesSlide", "ChartData",
    "PresentationProperties", "ViewProperties", "TableStyleSet", "PptxComment", "PresentationInfo", "PeoplePart", "Diagnostics",
)
# What counts as a node's content, and as its style.
CONTENT = {
    "Paragraph": "{text=}", "Run": "{text=}", "Hyperlink": "{target}", "Shape": "{text!}", "MacroModule": "{name}", "MacroProject": "{name!}", "ExternalReference": "{target}",
    "OleObject": "{prog_id|name!}", "ActiveXControl": "{prog_id|name!}", "DefinedName": "{name}", "TableDefinition": "{display_name|name!}", "Worksheet": "{cells_hash!}",
}
STYLE = {
    "Paragraph": "{properties!}", "Run": "{properties!}", "Table": "{properties!}", "Cell": "style={style_id}", "Worksheet": "state={state=Visible} kind={kind=Worksheet}",
    "Shape": "type={type} has_text={has_text=false}", "Slide": "layout_id={layout_id} master_id={master_id}",
}
# Labels of a cell's value in summaries and in signatures.
VALUE_LABELS = {
    "String": ("str:", "s:"), "Number": ("num:", "n:"), "Boolean": ("bool:", "b:"), "Error": ("error:", "e:"), "DateTime": ("date:", "dt:"), "InlineString": ("inline:", "is:"), "SharedString": ("shared:", "ss:"),
}


def rendered(template: str, attrs: Column) -> Column:
    """A template filled from a map of attributes."""
    parts = []
    for i, piece in enumerate(re.split(r"\{([^}]*)\}", template)):
        if i % 2 == 0:
            parts += [F.lit(piece)] if piece else []
            continue
        names, needed, default, kept = re.fullmatch(r"([\w|]+)(!)?(?:=([^~]*))?(?:~(\d+))?", piece).groups()
        value = F.coalesce(*(attrs[n] for n in names.split("|")), *([] if needed else [F.lit("-" if default is None else default)]))
        parts.append(S.abbreviate(value, int(kept)) if kept else value)
    return F.concat(*parts)


def by_type(kind: Column, attrs: Column, templates: dict[str, str], otherwise: Column | None = None) -> Column:
    """The template of each node's type, null (or ``otherwise``) for types without one."""
    chosen = F.when(F.lit(False), F.lit(""))
    for name, template in templates.items():
        chosen = chosen.when(kind == name, rendered(template, attrs))
    return chosen if otherwise is None else chosen.otherwise(otherwise)


def cell_value(attrs: Column, signature: bool = False) -> Column:
    """A cell's value with the label of its kind: in summaries numbers have no or six decimals and texts 60 characters, in
    signatures they are whole."""
    value, kind = F.coalesce(attrs["value"], F.lit("")), F.coalesce(attrs["value_kind"], F.lit("Empty"))
    shown = value if signature else F.when(kind.isin("Number", "DateTime"), S.format_float(value.try_cast("double"))).when(kind.isin("String", "InlineString"), S.abbreviate(value, 60)).otherwise(value)
    labels = F.create_map(*(F.lit(x) for k, v in VALUE_LABELS.items() for x in (k, v[signature])))
    return F.coalesce(F.concat(F.try_element_at(labels, kind), shown), F.lit("empty"))


def summary(kind: Column, attrs: Column) -> Column:
    formula = F.coalesce(F.concat(S.abbreviate(attrs["formula"], 80), F.lit(" type="), F.coalesce(attrs["formula_type"], F.lit("Normal"))), F.lit("-"))
    cell = F.concat(F.lit("ref="), F.coalesce(attrs["ref"], F.lit("-")), F.lit(" value="), cell_value(attrs), F.lit(" formula="), formula)
    return by_type(kind, attrs, SUMMARIES, F.when(kind == "Cell", cell).otherwise(F.concat(F.lit("unsupported="), kind)))


def own_key(kind: Column, attrs: Column) -> Column:
    """The key that a node has by itself: its type and its name in brackets, null if it has none."""
    bracketed = F.concat(kind, F.lit("["), by_type(kind, attrs, KEYED_BY), F.lit("]"))
    return F.when(kind.isin(*SINGLE), kind).otherwise(bracketed)


def content_signature(kind: Column, attrs: Column) -> Column:
    cell = F.concat(F.coalesce(attrs["ref"], F.lit("-")), F.lit("="), cell_value(attrs, True), F.coalesce(F.concat(F.lit(";"), attrs["formula"]), F.lit("")))
    return F.when(kind == "Cell", cell).otherwise(by_type(kind, attrs, CONTENT))


def style_signature(kind: Column, attrs: Column) -> Column:
    return by_type(kind, attrs, STYLE)


def snapshots(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``own_key``, ``summary``, ``content_sig`` and ``style_sig``, what an index holds of them."""
    kind, attrs = F.col("node_type"), F.col("attrs")
    return nodes.select("*", own_key(kind, attrs).alias("own_key"), summary(kind, attrs).alias("summary"), content_signature(kind, attrs).alias("content_sig"), style_signature(kind, attrs).alias("style_sig"))


def local_keys(snapshots: DataFrame, parent: list[str], order: list[str], store=stored) -> DataFrame:
    """``local_key``, unlike for all children of a parent: a node's own key, else its type with its place among the
    siblings of that type (paragraphs, runs, and nodes without content) or with the hash of its content. A key that an
    earlier sibling has gets the next free ``#n``, from ``#2`` on."""
    placed = ranked(snapshots, [*parent, "node_type"], order, store, "_place")
    hashed = F.when(~F.col("node_type").isin("Paragraph", "Run"), S.short_hash(F.col("content_sig")))
    base = F.coalesce("own_key", F.concat("node_type", F.lit("["), F.coalesce(hashed, F.col("_place").cast("string")), F.lit("]")))
    return allotted(placed.withColumn("local_key", base).drop("_place"), "local_key", parent, order, store)


def allotted(rows: DataFrame, key: str, parent: list[str], order: list[str], store) -> DataFrame:
    """``rows`` with ``key`` made unlike for all rows of a parent: in order, one that is taken gets the next free ``#n``.

    Keys of one parent meet only where they are equal but for such endings. Where a parent has one key of a stem the n-th
    equal one is ``#n``, numbered without a window over the parent. Rows of stems with several keys are sorted and passed through
    once; what is kept of a stem is a number for each of its keys, however many rows there are.
    """
    stemmed = rows.withColumn("_stem", F.regexp_replace(key, "(#[0-9]+)+$", ""))
    stem = [*parent, "_stem"]
    mixed = store(stemmed.groupBy(*stem).agg(F.min(key).alias("a"), F.max(key).alias("b")).filter("a <> b").select(*stem))
    alike = F.lit(True)
    for c in stem:
        alike = alike & F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}"))
    plain = stemmed.alias("r").join(mixed.alias("m"), alike, "left_anti")
    again = ranked(plain.drop("_stem"), [*parent, key], order, store, "_again")
    out = again.withColumn(key, F.when(F.col("_again") > 1, F.concat(key, F.lit("#"), F.col("_again").cast("string"))).otherwise(F.col(key))).drop("_again")
    names = rows.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, taken, last = None, set(), {}  # of the stem at hand: keys that are taken as they are, and the last number given to each
        for batch in batches:
            bases, given = batch.column(key).to_pylist(), []
            for base, *where in zip(bases, *(batch.column(c).to_pylist() for c in stem), strict=True):
                if where != at:
                    at, taken, last = where, set(), {}
                head, _, tail = base.rpartition("#")
                numbered = tail.isdigit() and not tail.startswith("0") and 2 <= int(tail) <= last.get(head, 1)
                if base not in taken and not numbered:
                    taken.add(base)
                    given.append(base)
                    continue
                n = last.get(base, 1) + 1
                while f"{base}#{n}" in taken:
                    n += 1
                last[base] = n
                given.append(f"{base}#{n}")
            columns = [pa.array(given, pa.string()) if c == key else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    sorted_ = stemmed.alias("r").join(mixed.alias("m"), alike, "left_semi").repartition(*stem).sortWithinPartitions(*stem, *order)
    return out.select(names).unionByName(sorted_.mapInArrow(each, rows.schema))


def path_keys(nodes: DataFrame, edges: DataFrame, store, most: int = 100) -> DataFrame:
    """(node, key): a row for every path from a root, so a node with two parents has two keys; a path stops where it
    meets itself.

    ``nodes`` is (node, local_key) with the roots' keys, ``edges`` (parent, child, local_key). ``store`` writes a level
    before the next is joined.
    """
    level = store(nodes.select("node", F.col("local_key").alias("key"), F.array("node").alias("path")))
    out = level
    for _ in range(most):
        step = level.join(edges, (F.col("node") == F.col("parent")) & ~F.array_contains("path", F.col("child")))
        level = store(step.select(F.col("child").alias("node"), F.concat_ws("/", "key", "local_key").alias("key"), F.concat("path", F.array("child")).alias("path")))
        if level.isEmpty():
            return out.select("node", "key")
        out = out.unionByName(level)
    raise ValueError(f"deeper than {most} levels")
