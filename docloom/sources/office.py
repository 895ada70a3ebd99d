"""Office documents as node and edge rows: OOXML and ODF text and sheets, HWPX text, and RTF.

Readers give a flat list of (parent, type, text, target) in document order; node ids are places in that list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "path string, node_id long, parent_id long, node_type string, text string, target string"
MOST_GROUPS = 256


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


#: Element to node type, by document family; text is that of the elements' own text leaves.
TYPES = {
    "docx": {"p": "Paragraph", "r": "Run", "hyperlink": "Hyperlink", "tbl": "Table", "tr": "TableRow", "tc": "TableCell", "sectPr": "Section"},
    "odt": {"p": "Paragraph", "h": "Paragraph", "a": "Hyperlink", "table": "Table", "table-row": "TableRow", "table-cell": "TableCell", "annotation": "Comment"},
    "hwpx": {"p": "Paragraph", "run": "Run", "tbl": "Table", "tr": "TableRow", "tc": "TableCell"},
    "pptx": {"sp": "Shape", "p": "Paragraph", "r": "Run"},
    "xlsx": {"c": "Cell", "hyperlink": "Hyperlink", "row": "Row"},
}
#: Elements nested deeper than this are refused.
MOST_DEPTH = 512
MAIN = {"docx": r"word/(document|header\d*|footer\d*|comments|footnotes|endnotes)\.xml", "odt": r"content\.xml", "ods": r"content\.xml", "odp": r"content\.xml", "hwpx": r"Contents/section\d+\.xml", "pptx": r"ppt/slides/slide\d+\.xml", "xlsx": r"xl/worksheets/[^/]+\.xml"}


def xml_nodes(kind: str, data: bytes, shared: list[str]) -> list[tuple[int | None, str, str | None, str | None]]:
    """(parent, type, text, target) of the known elements of a part, in document order."""
    types = TYPES["odt" if kind in ("ods", "odp") else kind]
    out: list[tuple[int | None, str, str | None, str | None]] = []

    stack = [(ElementTree.fromstring(data), None, 1)]
    while stack:
        element, parent, depth = stack.pop()
        if depth > MOST_DEPTH:
            raise ValueError(f"nested deeper than {MOST_DEPTH}")
        kind_of = types.get(_name(element.tag))
        if kind_of:
            attributes = {_name(k): v for k, v in element.attrib.items()}
            text = None
            if kind_of in ("Run", "Paragraph", "Hyperlink"):
                text = "".join(t.text or "" for t in element.iter() if _name(t.tag) in ("t", "span")) if kind not in ("odt", "ods", "odp") else "".join(element.itertext())
            elif kind_of == "Cell":
                raw = next((v.text or "" for v in element.iter() if _name(v.tag) in ("v", "t")), None)
                formula = next((v.text for v in element if _name(v.tag) == "f" and v.text), None)
                known = attributes.get("t") == "s" and raw is not None and raw.isdigit() and int(raw) < len(shared)
                text = "=" + formula if formula else shared[int(raw)] if known else raw
            out.append((parent, kind_of, text, attributes.get("href") or attributes.get("id") if kind_of == "Hyperlink" else attributes.get("r") if kind_of == "Cell" else None))
            parent = len(out) - 1
        stack += [(child, parent, depth + 1) for child in reversed(element)]
    return out


_TOKEN = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)|[\r\n]+")


def rtf_nodes(data: bytes) -> list[tuple[int | None, str, str | None, str | None]]:
    """(parent, type, text, target) of an RTF text: paragraphs, hyperlink fields, and embedded objects."""
    out: list[tuple[int | None, str, str | None, str | None]] = []
    skipped = {"colortbl", "stylesheet", "fonttbl", "listtable", "listoverridetable", "info", "pict", "header", "footer"}
    stack: list[dict] = []
    state = {"skip": False, "into": None}
    line: list[str] = []
    capture: dict[str, list[str]] = {}

    def paragraph():
        if text := "".join(line).strip():
            out.append((None, "Paragraph", text, None))
            out.append((len(out) - 1, "Run", text, None))
        line.clear()

    for m in _TOKEN.finditer(data):
        word, _, code, symbol, brace, text = m.groups()
        if brace == b"{":
            if len(stack) >= MOST_GROUPS:
                raise ValueError("too many groups")
            stack.append(dict(state))
        elif brace == b"}":
            if not stack:
                raise ValueError("a group ends that did not begin")
            done, state = state["into"], stack.pop()
            if done == "fldinst" and state["into"] != "fldinst":
                instruction = "".join(capture.pop("fldinst", []))
                if link := re.match(r'\s*HYPERLINK\s+"?([^"\s]+)', instruction):
                    out.append((None, "Hyperlink", instruction.strip(), link[1]))
            elif done == "objdata" and state["into"] != "objdata":
                capture.pop("objdata", None)
                out.append((None, "OleObject", "".join(capture.pop("objclass", [])).strip() or None, None))
        elif word:
            word = word.decode()
            if word in skipped:
                state["skip"] = True
            elif word in ("fldinst", "objdata", "objclass", "objname"):
                state["into"] = word
            elif word in ("par", "cell", "row", "line"):
                paragraph()
            elif word == "tab":
                line.append("\t")
        elif not state["skip"]:
            piece = bytes.fromhex(code.decode()).decode("cp1252", "replace") if code else symbol.decode("cp1252") if symbol in (b"\\", b"{", b"}") else " " if symbol == b"~" else (text or b"").decode("cp1252", "replace")
            (capture.setdefault(state["into"], []) if state["into"] else line).append(piece)
    if stack:
        raise ValueError("a group does not end")
    paragraph()
    return out


def _rows(path: str, nodes: list, first: int) -> list[tuple]:
    return [(path, first + i, 0 if p is None else first + p, kind, text, target) for i, (p, kind, text, target) in enumerate(nodes)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in NODES.split(", ")])


def rtf_documents(files: DataFrame) -> DataFrame:
    """Nodes of the RTF files among (path, content); a file that cannot be read gives one Diagnostic node."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    nodes = rtf_nodes(content.as_py())
                except ValueError as error:
                    nodes = [(None, "Diagnostic", str(error), None)]
                yield _batch([(path, 0, None, "Document", None, None), *_rows(path, nodes, 1)])

    rtf = files.filter(F.hex(F.substring("content", 1, 5)) == "7B5C727466").select("path", "content")
    return rtf.mapInArrow(each, NODES)


def package_documents(parts_of: DataFrame, formats_of: DataFrame) -> DataFrame:
    """Nodes of OOXML, ODF and HWPX packages from their parts. A task holds one document's parts."""
    wanted = parts_of.join(formats_of.select("path", "format"), "path").filter("content is not null and format <> 'zip'")
    used = F.lit(False)
    for kind, pattern in MAIN.items():
        used |= (F.col("format") == kind) & (F.col("part").rlike(f"^{pattern}$") | (F.col("part") == "xl/sharedStrings.xml"))

    def each(pdf):
        import pandas as pd

        pdf = pdf.sort_values("part")
        kind, path = pdf["format"].iloc[0], pdf["path"].iloc[0]
        shared: list[str] = []
        rows = [(path, 0, None, "Document", None, None)]
        for data in pdf["content"][pdf["part"] == "xl/sharedStrings.xml"]:
            try:
                shared = ["".join(t.text or "" for t in si.iter() if _name(t.tag) == "t") for si in ElementTree.fromstring(data)]
            except ElementTree.ParseError as error:
                rows += _rows(path, [(None, "Diagnostic", f"xl/sharedStrings.xml: {error}", None)], len(rows))
        for part, data in zip(pdf["part"], pdf["content"], strict=True):
            if part != "xl/sharedStrings.xml":
                try:
                    nodes = xml_nodes(kind, data, shared)
                except (ElementTree.ParseError, ValueError) as error:
                    nodes = [(None, "Diagnostic", f"{part}: {error}", None)]
                rows += _rows(path, nodes, len(rows))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in NODES.split(", ")]).astype({"parent_id": "Int64"})

    return wanted.filter(used).groupBy("path").applyInPandas(each, NODES)


def edges(nodes: DataFrame) -> DataFrame:
    return nodes.filter("parent_id is not null").select("path", "parent_id", F.col("node_id").alias("child_id"))
