"""Decoders of inner streams."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from docloom.sources import streams


def test_vba_decompression(spark):
    assert streams.vba_decompressed(b"") is None
    assert streams.vba_decompressed(b"plain") == b"plain"
    # one chunk: a flag byte, "abc" as literals, then a copy of 6 bytes from 3 back
    body = bytes([0b1000]) + b"abc" + struct.pack("<H", (2 << 12) | 3)
    packed = b"\x01" + struct.pack("<H", 0xB000 | (len(body) - 1)) + body
    assert streams.vba_decompressed(packed) == b"abcabcabc"
    assert streams.vba_decompressed(b"\x01" + struct.pack("<H", 0xB002) + bytes([1, 0xFF, 0xFF])) is None
    rows = spark.createDataFrame([("a", b"Sub A()\r\nEnd Sub"), ("b", None)], "path string, content binary")
    assert sorted(tuple(r) for r in streams.macro_sources(rows).collect()) == [("a", "Sub A()\nEnd Sub"), ("b", None)]


def test_slide_records_nest(spark):
    atom = struct.pack("<HHI", 0x10, 0x0FA0, 4) + b"text"
    data = struct.pack("<HHI", 0x0F, 1000, len(atom)) + atom + atom
    rows = spark.createDataFrame([("p", data), ("n", None)], "path string, content binary")
    got = streams.decoded(rows, "slides").orderBy("seq").collect()
    assert [(r["record_type"], r["depth"], r["is_container"], r["instance"]) for r in got] == [(1000, 0, True, 0), (4000, 1, False, 1), (4000, 0, False, 1)]


def test_flash_and_native():
    swf = b"FWS\x08" + struct.pack("<I", 12) + b"FWS!"
    assert list(streams.flash_objects(b"xx" + swf + b"CWS\x00" + struct.pack("<I", 99) + b"ZWS\x05" + struct.pack("<I", 500))) == [(2, "FWS", 8, 12, False), (22, "ZWS", 5, 500, True)]
    data = struct.pack("<IH", 0, 2) + b"a.exe\0C:\\a.exe\0" + b"\0" * 8 + b"C:\\t\0" + struct.pack("<I", 3) + b"xyz"
    assert streams.native_payload(data) == ("a.exe", "C:\\a.exe", "C:\\t", b"xyz")
    assert streams.native_payload(b"short") is None


def test_project_lines(spark):
    text = 'Name="VBAProject"\r\nModule=Module1\r\nDocument=ThisDocument/&H0\r\nDPB="0E0C"\r\n\r\nx'
    got = spark.range(1).select(streams.project_entries(F.lit(text)).alias("e")).first()["e"]
    assert [(r["kind"], r["name"]) for r in got] == [("Name", "VBAProject"), ("Module", "Module1"), ("Document", "ThisDocument"), ("Protected", "0E0C")]
