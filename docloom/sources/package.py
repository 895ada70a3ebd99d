"""ZIP packages: parts as rows, with the guards of an untrusted archive."""

from __future__ import annotations

import io
import lzma
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import containers

MOST_TOTAL, MOST_FILE, MOST_FILES, MOST_RATIO, MOST_DEPTH = 100 << 20, 50 << 20, 10_000, 100, 20
_BROKEN = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, struct.error, EOFError, OSError, RuntimeError, ValueError)
PARTS = "path string, part string, size long, content binary, error string"


def entry_error(name: str, size: int, packed: int) -> str | None:
    """Why an archive entry is refused, or None."""
    low = name.lower()
    if "\0" in name or "\\" in name or name.startswith("/") or re.match("[A-Za-z]:", name) or ".." in name or re.search("%2e|%2f|%5c", low):
        return "path-traversal"
    if name.count("/") > MOST_DEPTH:
        return "too-deep"
    if size > MOST_FILE:
        return "file-too-large"
    return "compression-ratio" if packed and size / packed > MOST_RATIO else None


def read_parts(data: bytes) -> Iterator[tuple[str | None, int, bytes | None, str | None]]:
    """(part, size, content, error) of each entry; one row with an error for an archive refused as a whole."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        entries = [e for e in archive.infolist() if not e.is_dir()]
    except _BROKEN:
        yield None, 0, None, "bad-archive"
        return
    names = [e.filename.lower() for e in entries]
    if len(set(names)) < len(names) or len(names) > MOST_FILES or sum(e.file_size for e in entries) > MOST_TOTAL:
        yield None, 0, None, "duplicate-names" if len(set(names)) < len(names) else "too-many-files" if len(names) > MOST_FILES else "archive-too-large"
        return
    for e in entries:
        error, content = entry_error(e.filename, e.file_size, e.compress_size) or ("encrypted" if e.flag_bits & 1 else None), None
        if not error:
            try:
                content = archive.read(e)
            except _BROKEN:  # a wrong checksum, cut data, an unknown method
                error = "bad-entry"
        yield e.filename, e.file_size, content, error


def parts(files: DataFrame) -> DataFrame:
    """(path, part, size, content, error) of the ZIP files among (path, content)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = [(path, *row) for row in read_parts(content.as_py())]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["path", "part", "size", "content", "error"])

    zips = files.filter(F.hex(F.substring("content", 1, 4)) == "504B0304").select("path", "content")
    return zips.mapInArrow(each, PARTS)


# The content types of main parts, and the formats they mean; main parts in the order in which they are asked.
MAIN_TYPES = {
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml": "docx",
    "application/vnd.ms-word.document.macroEnabled.main+xml": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml": "xlsx",
    "application/vnd.ms-excel.sheet.macroEnabled.main+xml": "xlsx",
    "application/vnd.ms-excel.sheet.binary.macroEnabled.main": "xlsb",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml": "pptx",
    "application/vnd.ms-powerpoint.presentation.macroEnabled.main+xml": "pptx",
}
MAIN_PARTS = ("word/document.xml", "xl/workbook.xml", "xl/workbook.bin", "ppt/presentation.xml")
MIMETYPES = {"hwp+zip": "hwpx", "opendocument.text": "odt", "opendocument.spreadsheet": "ods", "opendocument.presentation": "odp"}


def _files(parts_of: DataFrame, which: Column) -> DataFrame:
    return parts_of.filter(which & F.col("content").isNotNull()).select(F.col("path").alias("doc_id"), F.col("part").alias("path"), F.decode("content", "UTF-8").alias("xml"))


def content_types(parts_of: DataFrame) -> DataFrame:
    """(path, ord, kind, key, content_type, error): the entries of each package's content types; one with an error refuses them."""
    return containers.content_type_entries(_files(parts_of, F.col("part") == "[Content_Types].xml")).withColumnRenamed("doc_id", "path")


def formats(parts_of: DataFrame) -> DataFrame:
    """(path, format, error) of each package: by the content type of its first main part (an override, else the default of its
    extension), or by its mimetype, else ``zip``; so too, with the first error, where an entry of the content types has one."""
    entries = content_types(parts_of)
    held = lambda kind, key: F.max(F.when((F.col("kind") == kind) & (F.col("key") == key), F.col("content_type")))
    chosen = F.lit(None).cast("string")
    known = F.create_map(*(F.lit(x) for kv in MAIN_TYPES.items() for x in kv))
    for part in reversed(MAIN_PARTS):
        form = F.try_element_at(known, F.coalesce(held("Override", part), held("Default", part.rpartition(".")[2])))
        chosen = F.coalesce(form, chosen)
    typed = entries.groupBy("path").agg(chosen.alias("main"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("ord"))).alias("error"))
    mime = F.max(F.when(F.col("part") == "mimetype", F.decode("content", "UTF-8")))
    named = parts_of.filter("part is not null").groupBy("path").agg(mime.alias("mime")).join(typed, "path", "left")
    by_mime = F.coalesce(*(F.when(F.contains("mime", F.lit(m)), f) for m, f in MIMETYPES.items()))
    return named.select("path", F.coalesce(F.when(F.col("error").isNull(), F.col("main")), by_mime, F.lit("zip")).alias("format"), "error")


def relationship_faults(parts_of: DataFrame) -> DataFrame:
    """(path, part, error): the first error of each .rels part that has one; it gives no relationships."""
    bad = _relationships(parts_of).filter("error is not null")
    return bad.groupBy("path", "part").agg(F.min_by("error", "ord").alias("error"))


def _relationships(parts_of: DataFrame) -> DataFrame:
    rows = containers.relationship_entries(_files(parts_of, F.endswith("part", F.lit(".rels"))))
    return rows.withColumnsRenamed({"path": "part", "doc_id": "path"})


def relationships(parts_of: DataFrame) -> DataFrame:
    """(path, source, rel_id, rel_type, target, external) of all .rels parts without errors, read as XML text by expressions."""
    rows = _relationships(parts_of)
    good = rows.join(rows.filter("error is not null").select("path", "part").distinct(), ["path", "part"], "left_anti")
    source = F.regexp_replace("part", r"_rels/([^/]*)\.rels$", "$1")
    return good.select("path", source.alias("source"), F.col("id").alias("rel_id"), F.regexp_extract("type", "[^/]*$", 0).alias("rel_type"), "target", (F.col("mode") == "External").alias("external"))
