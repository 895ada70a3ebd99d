"""Small byte decoders for streams inside containers, and the tables that they fill.

Each decoder handles one bounded stream; Spark spreads the streams.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_SOURCE, MOST_DEPTH, MOST_RECORDS = 10 << 20, 100, 1_000_000


def vba_decompressed(data: bytes) -> bytes | None:
    """The text of a compressed macro stream; data without the signature byte is passed through."""
    if not data or data[0] != 1:
        return data or None
    out, at = bytearray(), 1
    while at + 2 <= len(data):
        header, = struct.unpack_from("<H", data, at)
        end = min(len(data), at + (header & 0xFFF) + 3)
        at += 2
        if not header & 0x8000:
            out += data[at:end]
            at = end
            continue
        start = len(out)
        while at < end:
            flags = data[at]
            at += 1
            for bit in range(8):
                if at >= end:
                    break
                if not flags >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                if at + 2 > end:
                    return None
                token, = struct.unpack_from("<H", data, at)
                at += 2
                width = max(4, (len(out) - start - 1).bit_length())
                length, offset = (token & (0xFFFF >> width)) + 3, (token >> (16 - width)) + 1
                if offset > len(out) - start:
                    return None
                for _ in range(length):
                    out.append(out[-offset])
        if len(out) > MOST_SOURCE:
            return None
    return bytes(out)


def slide_records(data: bytes) -> Iterator[tuple[int, int, int, int, int, int, int, bool]]:
    """(seq, offset, type, version, instance, length, depth, is_container) of a slide stream; version 15
    records hold further ones."""
    at, ends, seq = 0, [len(data)], 0
    while at + 8 <= len(data) and seq < MOST_RECORDS:
        while len(ends) > 1 and at >= ends[-1]:
            ends.pop()
        first, kind, length = struct.unpack_from("<HHI", data, at)
        holds = first & 15 == 15
        if at + 8 + length > ends[-1]:
            return
        yield seq, at, kind, first & 15, first >> 4, length, len(ends) - 1, holds
        seq += 1
        at += 8 if holds else 8 + length
        if holds and len(ends) <= MOST_DEPTH:
            ends.append(at + length)
        elif holds:
            at += length


def flash_objects(data: bytes) -> Iterator[tuple[int, str, int, int, bool]]:
    """(offset, signature, version, declared_size, truncated) of Flash files inside the bytes."""
    at = 0
    while (found := min((p for s in (b"FWS", b"CWS", b"ZWS") if (p := data.find(s, at)) >= 0), default=-1)) >= 0:
        at = found + 3
        if found + 8 <= len(data):
            version, (size,) = data[found + 3], struct.unpack_from("<I", data, found + 4)
            if version and size >= 8:
                yield found, data[found : found + 3].decode(), version, size, found + size > len(data)
                at = max(at, min(len(data), found + size))


def native_payload(data: bytes) -> tuple[str, str, str, bytes] | None:
    """(file, source, temporary name, payload) of an Ole10Native stream."""
    try:
        at, names = 6, []
        for skip in (0, 8, 0):
            end = data.index(b"\0", at)
            names.append(data[at:end].decode("cp1252"))
            at = end + 1 + (skip if len(names) == 2 else 0)
        size, = struct.unpack_from("<I", data, at)
    except (ValueError, struct.error):
        return None
    return (*names, data[at + 4 : at + 4 + size])


_I = pa.int64()
TABLES = {
    "slides": (slide_records, "seq long, offset long, record_type long, version long, instance long, length long, depth long, is_container boolean", (_I,) * 7 + (pa.bool_(),)),
    "flash": (flash_objects, "offset long, signature string, version long, declared_size long, truncated boolean", (_I, pa.string(), _I, _I, pa.bool_())),
}


def decoded(streams: DataFrame, table: str) -> DataFrame:
    """Rows of ``TABLES[table]`` for each of the streams (path, content); null content gives none."""
    decode, schema, kinds = TABLES[table]
    names = ["path", *(x.split()[0] for x in schema.split(", "))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = [(path, *r) for r in decode(content.as_py() or b"")]
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *kinds), strict=True)], names)

    return streams.select("path", "content").mapInArrow(each, f"path string, {schema}")


def macro_sources(streams: DataFrame) -> DataFrame:
    """(path, source): decompressed macro text with plain line ends; null where it cannot be decoded."""

    @F.udf("binary")
    def plain(data):
        return None if data is None else vba_decompressed(bytes(data))

    text = F.decode(plain("content"), "UTF-8")
    return streams.select("path", F.regexp_replace(text, "^\ufeff|\r(?=\n)", "").alias("source"))


def project_entries(text: Column) -> Column:
    """(kind, name) of the lines of a PROJECT stream; a DPB line tells that the project is protected."""
    lines = F.split(text, "\r?\n")
    kind = lambda s: F.regexp_extract(s, "^(Name|Module|Class|Document|BaseClass|Reference|DPB)=", 1)
    value = lambda s: F.regexp_extract(s, '^[A-Za-z]+="?([^"/]*)', 1)
    return F.transform(F.filter(lines, lambda s: kind(s) != ""), lambda s: F.struct(F.when(kind(s) == "DPB", "Protected").otherwise(kind(s)).alias("kind"), value(s).alias("name")))
