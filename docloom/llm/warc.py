"""WARC archives with payload deduplication and a globally ordered capture index.

Writing: a page's payload is its html in UTF-8. Of pages with equal payloads of ``LEAST`` bytes or more, the
one with the smallest id is a ``response``, the others are ``revisit`` records that refer to it. Records are
text, written by Spark's text writer with the record end as line separator (gzip), so that files are committed
as any Spark output is. Each file is a run sorted by URL key and timestamp, cut where its records' bytes would exceed
``RUN_BYTES`` (a longer record is a run of its own).

Reading: each file is parsed by the records' lengths; payload digests of responses are computed anew. The index
rows of the runs are cut into ranges of (URL key, timestamp, id, run, offset) of about ``RANGE_ROWS`` rows; each range's
task merges its slices of the sorted runs with a loser tree, and (range, place) orders all captures of all URLs. A range
holds index rows alone, and a URL, even a repeated row, with very many captures spans several ranges: a task holds as
much however large the table is.

A page without a capture time gets one from its id. Nulls: a null html is an empty payload, a null url an empty
URL; a null id is the smallest of its group only if no row has one. Repeated rows each get a record; those with
the id of the response are responses. A payload of any length is one record. Further columns are not looked at,
whatever their names. Empty input gives an empty archive.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST = 100
RUN_BYTES = 16 << 20
RANGE_ROWS = 1 << 16
END = "\r\n\r\n"
INDEX = "urlkey string, ts string, page_id long, run string, offset long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str) -> Column:
    """The host's labels in reverse order, then port and path: all pages of a host stand together."""
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:www\.)?([^/?#:]*)([^#]*)"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(url, parts, 1)), r"\.")), ",")
    return F.when(F.col(url).rlike(parts), F.concat(host, F.lit(")"), F.regexp_extract(url, parts, 2))).otherwise(F.col(url))


def _header(*fields: tuple[str, Column]) -> Column:
    """Lines "name: value"; null values are left out."""
    return F.concat_ws("\r\n", F.lit("WARC/1.1"), *(F.concat(F.lit(f"{k}: "), v) for k, v in fields))


def records(pages: DataFrame) -> DataFrame:
    """(urlkey, ts, page_id, record), the record without its end."""
    payload = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(pages["url"], F.lit("")), r"[\r\n]", "").alias("url"),
        payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload.cast("binary"), 256).alias("digest"),
    )
    found = rows.filter(F.col("bytes") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    rows = rows.join(common.stored(found.filter("n > 1").select("digest", "first"), "digests"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    day = F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 30))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8")
    block = F.concat(http, F.lit(END), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    header = _header(
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), ("WARC-Record-ID", urn("page_id")),
        ("WARC-Target-URI", F.col("url")), ("WARC-Date", F.col("ts")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Refers-To", F.when(revisit, urn("first"))), ("X-Payload-Length", F.col("bytes").cast("string")), ("X-Url-Key", F.col("urlkey")),
        ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(block).cast("string")),
    )
    rows = rows.withColumn("ts", day).withColumn("urlkey", url_key("url"))
    return rows.select("urlkey", "ts", "page_id", F.concat(header, F.lit(END), block).alias("record"))


def write(pages: DataFrame, path: str, run_bytes: int = RUN_BYTES) -> None:
    """Write ``pages`` as sorted runs under ``path``: a row for each run, its records joined by their ends, and a file
    for each row."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in common.slices(batches, "record"):
            for record in batch.column("record").cast(pa.binary()).to_pylist():
                if held and size + len(record) > run_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([END.encode().join(held)]).cast(pa.string())], ["value"])
                    held, size = [], 0
                held.append(record)
                size += len(record) + len(END)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([END.encode().join(held)]).cast(pa.string())], ["value"])

    runs = records(pages).sortWithinPartitions("urlkey", "ts", "page_id").select("record").mapInArrow(joined, "value string")
    runs.write.options(lineSep=END, compression="gzip", maxRecordsPerFile=1).text(path)


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record of an archive."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        end = stop + 4 + int(fields["Content-Length"])
        yield at, fields, data[stop + 4 : end]
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} has no end")
        at = end + 4


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the runs under ``path``, in each run's order."""

    def number(urn: str | None) -> int | None:
        return int(urn[len("<urn:page:") : -1]) if urn else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for offset, f, block in parse(zlib.decompress(content.as_py(), wbits=31)):
                    digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                    if f["WARC-Type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(f["X-Payload-Length"]):
                            raise ValueError(f"{run}: the payload at {offset} is not the one written")
                    rows.append((f["X-Url-Key"], f["WARC-Date"], number(f.get("WARC-Record-ID")), run, offset, int(f["X-Payload-Length"]), digest, f["WARC-Type"], number(f.get("WARC-Refers-To"))))
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = [x.split()[0] for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names)

    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).select("path", "content")
    return files.mapInArrow(each, INDEX)


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of the match below it, so that the next
    winner needs one comparison per level."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.at = runs, [0] * len(runs)
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.head: list[tuple | None] = [r[0] if r else None for r in runs] + [None] * (self.size - len(runs))
        self.losers = [0] * self.size
        winners = list(range(self.size))
        level = self.size
        while level > 1:
            level //= 2
            matches = [(winners[2 * i], winners[2 * i + 1]) for i in range(level)]
            for i, (a, b) in enumerate(matches):
                winners[i], self.losers[level + i] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[0]

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or x is not None and (x, a) <= (y, b)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, position) in merged order; equal keys by run."""
        while self.head[w := self.winner] is not None:
            yield w, self.at[w]
            self.at[w] += 1
            self.head[w] = self.runs[w][self.at[w]] if self.at[w] < len(self.runs[w]) else None
            node = (self.size + w) // 2
            while node:
                if self._before(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def merged(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The index in global order: ``range`` and ``place`` sort all rows by URL key, timestamp and id."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)  # the index rows of one range
        key = list(zip(table["urlkey"].to_pylist(), table["ts"].to_pylist(), ((x is not None, x or 0) for x in table["page_id"].to_pylist()), strict=True))
        slices: dict[str, list[int]] = {}
        for i, run in enumerate(table["run"].to_pylist()):
            slices.setdefault(run, []).append(i)
        runs = list(slices.values())
        order = [runs[r][p] for r, p in LoserTree([[key[i] for i in rows] for rows in runs])]
        out = table.take(pa.array(order)).append_column("place", pa.array(range(len(order)), pa.int64()))
        yield from out.combine_chunks().to_batches()

    ranges = max(1, -(-index.count() // range_rows))
    ranged = index.repartitionByRange(ranges, F.col("urlkey"), F.col("ts"), F.col("page_id").asc_nulls_first(), F.col("run"), F.col("offset"))
    ranged = ranged.withColumn("range", F.spark_partition_id()).sortWithinPartitions("run", "offset")
    return ranged.mapInArrow(each, INDEX + ", range int, place long")


def op5_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "warc")
    write(common.table(spark, sf_dir, "pages"), path)
    index = common.stored(read_index(spark, path), "index")
    return merged(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts", "range", "place")
