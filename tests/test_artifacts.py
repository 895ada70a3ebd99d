"""Payload files and manifests, with tasks that fail, run twice, or find the folder taken."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import Row

from docloom.sources import artifacts

ROWS = [(i % 7, f"macro {i % 5}/x.bin" if i % 11 else None, "vba", bytes([i]) * i if i else None) for i in range(60)]


def files_of(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(path) for f in names if not f.endswith(".crc")}


def check(spark, path, rows):
    held = files_of(path)
    found = artifacts.manifests(spark, f"file://{path}").collect()
    assert len(found) == len(rows)
    for r in found:
        data = held[f"{r.part}/{r.file}"]
        assert (r.size, r.sha256) == (len(data), hashlib.sha256(data).hexdigest())
    assert sorted((r.doc_id, r.name, r.kind, held[f"{r.part}/{r.file}"]) for r in found if r.name) == sorted((d, n, k, p or b"") for d, n, k, p in rows if n)
    payloads = [f for f in held if not f.endswith(artifacts.MANIFEST) and f != artifacts.DONE]
    assert len(payloads) == len(rows) and artifacts.DONE in held and not any(f.startswith(artifacts.STAGING) for f in held)


def test_written_by_tasks(spark, tmp_path):
    artifacts.register(spark)
    rows = spark.createDataFrame(ROWS, artifacts.SCHEMA).repartition(5)
    rows.write.format("artifacts").mode("append").save(f"{tmp_path}/out")
    check(spark, f"{tmp_path}/out", ROWS)
    with pytest.raises(Exception, match="is there already"):
        rows.write.format("artifacts").mode("append").save(f"{tmp_path}/out")
    check(spark, f"{tmp_path}/out", ROWS)
    rows.limit(3).write.format("artifacts").mode("append").option("overwrite", "true").save(f"{tmp_path}/out")
    assert artifacts.manifests(spark, f"{tmp_path}/out").count() == 3
    spark.createDataFrame([], artifacts.SCHEMA).write.format("artifacts").mode("append").save(f"{tmp_path}/none")
    assert set(files_of(f"{tmp_path}/none")) == {artifacts.DONE}


def as_rows(rows):
    return [Row(doc_id=d, name=n, kind=k, payload=p) for d, n, k, p in rows]


def test_a_failed_and_a_second_attempt_leave_one_copy(spark, tmp_path):
    path = f"{tmp_path}/out"
    writer = artifacts.ArtifactWriter(path, overwrite=False)

    def failing():
        yield from as_rows(ROWS[:10])
        raise OSError("the executor is lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(failing())
    first, again, rest = writer.write(iter(as_rows(ROWS[:30]))), writer.write(iter(as_rows(ROWS[:30]))), writer.write(iter(as_rows(ROWS[30:])))
    assert first.files == again.files
    writer.commit([again, rest, None])
    check(spark, path, ROWS)


def test_an_aborted_write_leaves_nothing_but_the_folder(tmp_path):
    writer = artifacts.ArtifactWriter(f"{tmp_path}/out", overwrite=False)
    writer.abort([writer.write(iter(as_rows(ROWS)))])
    assert files_of(f"{tmp_path}/out") == {}
