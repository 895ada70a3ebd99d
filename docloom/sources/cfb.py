"""Compound files: directory slots, sector chains and record headers as rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
END, FREE, NONE = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFF
MOST_ENTRIES, MOST_RECORDS = 65_536, 1_000_000
#: Powers of two of the sector sizes there are.
SHIFTS = (9, 12)
TYPES = {0: "unknown", 1: "storage", 2: "stream", 5: "root"}
SLOTS = "path string, slot long, name string, entry_type string, left long, right long, child long, start_sector long, size long, created long, modified long"


class Compound:
    """The tables of one compound file: sector size, FAT and directory."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC or len(data) < 512:
            raise ValueError("no compound file")
        shift, = struct.unpack_from("<H", data, 30)
        if shift not in SHIFTS:
            raise ValueError(f"sectors of 2^{shift} bytes")
        self.data, self.size = data, 1 << shift
        self.directory_start, = struct.unpack_from("<I", data, 48)
        difat = list(struct.unpack_from("<109I", data, 76))
        at, left = struct.unpack_from("<II", data, 68)
        while at not in (END, FREE) and left:
            if len(block := self.sector(at)) < self.size:
                raise ValueError("a sector of the allocation list is cut off")
            more = struct.unpack(f"<{self.size // 4}I", block)
            difat, at, left = [*difat, *more[:-1]], more[-1], left - 1
        self.fat: list[int] = []
        for s in difat:
            if s < END - 3 and len(block := self.sector(s)) == self.size:
                self.fat += struct.unpack(f"<{self.size // 4}I", block)

    def sector(self, i: int) -> bytes:
        return self.data[(i + 1) * self.size : (i + 2) * self.size]

    def chain(self, start: int) -> list[int]:
        """Sectors from ``start`` until the end mark, a sector outside the table, or one seen before."""
        out, seen = [], set()
        while start < len(self.fat) and start not in seen:
            seen.add(start)
            out.append(start)
            start = self.fat[start]
        return out

    def stream(self, start: int, size: int) -> bytes:
        return b"".join(map(self.sector, self.chain(start)))[:size]

    def slots(self) -> Iterator[tuple]:
        directory = b"".join(map(self.sector, self.chain(self.directory_start)))
        for i in range(min(MOST_ENTRIES, len(directory) // 128)):
            e = directory[i * 128 : i * 128 + 128]
            length, kind = struct.unpack_from("<HB", e, 64)
            left, right, child = (None if p == NONE else p for p in struct.unpack_from("<III", e, 68))
            created, modified, start, size = struct.unpack_from("<QQIQ", e, 100)
            yield i, e[: max(0, min(64, length) - 2)].decode("utf-16-le", "replace"), TYPES.get(kind, "unknown"), left, right, child, start, size & 0xFFFFFFFFFFFF, created, modified


def _table(files: DataFrame, schema: str, kinds: tuple, rows_of) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    rows = [(path, *r) for r in rows_of(Compound(content.as_py()))]
                except (ValueError, struct.error):  # reported by ``faults``
                    rows = []
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    cfb = files.filter((F.hex(F.substring("content", 1, 8)) == MAGIC.hex().upper()) & (F.length("content") >= 512)).select("path", "content")
    return cfb.mapInArrow(each, schema)


def slots(files: DataFrame) -> DataFrame:
    """Directory slots of the compound files among (path, content)."""
    i = pa.int64()
    return _table(files, SLOTS, (pa.string(), i, pa.string(), pa.string(), i, i, i, i, i, i, i), lambda c: c.slots())


def faults(files: DataFrame) -> DataFrame:
    """(path, error) of the compound files among (path, content) whose tables cannot be read; they have no rows elsewhere."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    list(Compound(content.as_py()).slots())
                except (ValueError, struct.error) as error:
                    found.append((path, str(error)))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], ["path", "error"])

    cfb = files.filter(F.hex(F.substring("content", 1, 8)) == MAGIC.hex().upper()).select("path", "content")
    return cfb.mapInArrow(each, "path string, error string")


def chains(files: DataFrame) -> DataFrame:
    """(path, slot, pos, sector): the sectors of each stream in the FAT."""
    i = pa.int64()
    rows = lambda c: ((s[0], k, sector) for s in c.slots() if s[2] == "stream" and s[7] >= 4096 for k, sector in enumerate(c.chain(s[6])))
    return _table(files, "path string, slot long, pos long, sector long", (pa.string(), i, i, i), rows)


def record_headers(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(seq, offset, type, size) of a BIFF stream's records, up to the first that is cut off."""
    at = seq = 0
    while at + 4 <= len(data) and seq < MOST_RECORDS:
        kind, size = struct.unpack_from("<HH", data, at)
        if at + 4 + size > len(data):
            return
        yield seq, at, kind, size
        at, seq = at + 4 + size, seq + 1


def sheet_records(files: DataFrame) -> DataFrame:
    """(path, seq, offset, record_type, size) of the Workbook (else Book) stream."""
    i = pa.int64()

    def rows(c: Compound):
        streams = {s[1]: s for s in c.slots() if s[2] == "stream"}
        s = streams.get("Workbook") or streams.get("Book")
        return record_headers(c.stream(s[6], s[7])) if s else ()

    return _table(files, "path string, seq long, offset long, record_type long, size long", (pa.string(), i, i, i, i), rows)
