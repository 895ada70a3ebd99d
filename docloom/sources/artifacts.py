"""Payload files and their manifest, written by Spark tasks through a data source with a commit protocol.

``rows.write.format("artifacts").mode("append").save(path)`` (after ``register``) writes a file for each row of
(doc_id, name, kind, payload). A task writes into a folder of its own below ``_staging``, and its manifest beside them; only
when all tasks are done are the folders of the attempts that won renamed into place, so a task that fails and runs again, or
twice, leaves one copy. The driver moves one folder for each task and sees no file. A folder that is there already is an error
unless ``overwrite`` is true: then its earlier parts go once the new ones are in place.

``path`` is one that all executors reach: a local or mounted folder (with or without ``file:``) or a store that pyarrow's file
systems know. Null payloads are empty files, null names ``unnamed``; names keep letters, digits, dots, dashes and underscores,
and get their place among the task's rows before them, so equal names do not meet.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

STAGING, MANIFEST, DONE = "_staging", "manifest.jsonl", "_SUCCESS"
SCHEMA = "doc_id long, name string, kind string, payload binary"


def _on(path: str):
    """pyarrow's file system of a path, and the path on it."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)


def _there(files, path: str) -> bool:
    from pyarrow import fs

    return files.get_file_info(path).type != fs.FileType.NotFound


@dataclass
class Part(WriterCommitMessage):
    """What a task hands to the driver: its folder and how many files are in it."""

    folder: str
    files: int


class ArtifactWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex
        files, root = _on(path)
        if _there(files, root) and not overwrite:
            raise FileExistsError(f"{path} is there already")
        files.create_dir(f"{root}/{STAGING}/{self.run}", recursive=True)

    def write(self, iterator: Iterator[Row]) -> Part:
        files, root = _on(self.path)
        folder = f"part-{uuid.uuid4().hex}"
        own = f"{root}/{STAGING}/{self.run}/{folder}"
        files.create_dir(own, recursive=True)
        n = 0
        with files.open_output_stream(f"{own}/{MANIFEST}") as manifest:
            for n, row in enumerate(iterator, 1):
                payload = bytes(row["payload"] or b"")
                name = f"{n:06d}-{re.sub('[^A-Za-z0-9._-]', '_', row['name'] or 'unnamed')}"
                with files.open_output_stream(f"{own}/{name}") as out:
                    out.write(payload)
                entry = {"doc_id": row["doc_id"], "file": name, "kind": row["kind"], "name": row["name"], "sha256": hashlib.sha256(payload).hexdigest(), "size": len(payload)}
                manifest.write(json.dumps(entry, sort_keys=True, ensure_ascii=False).encode() + b"\n")
        return Part(folder, n)

    def commit(self, messages: list[Part | None]) -> None:
        """Move the folders of the tasks that wrote files into place, drop all others, and say that the write is whole."""
        files, root = _on(self.path)
        from pyarrow import fs

        old = [f.path for f in files.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("part-")]
        for message in messages:
            if message and message.files:
                files.move(f"{root}/{STAGING}/{self.run}/{message.folder}", f"{root}/{message.folder}")
        for path in old:
            files.delete_dir(path)
        self._clean(files, root)
        with files.open_output_stream(f"{root}/{DONE}"):
            pass

    def abort(self, messages: list[Part | None]) -> None:
        self._clean(*_on(self.path))

    def _clean(self, files, root: str) -> None:
        if _there(files, f"{root}/{STAGING}"):
            files.delete_dir(f"{root}/{STAGING}")


class Artifacts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(self.options["path"], overwrite or self.options.get("overwrite", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Artifacts)


def manifests(spark: SparkSession, path: str):
    """(doc_id, file, kind, name, sha256, size) of all files of a whole write, with the folder (part) each is in."""
    from pyspark.sql import functions as F

    rows = spark.read.schema("doc_id long, file string, kind string, name string, sha256 string, size long").json(f"{path}/part-*/{MANIFEST}")
    return rows.withColumn("part", F.regexp_extract(F.input_file_name(), r"/(part-[0-9a-f]+)/[^/]*$", 1))
