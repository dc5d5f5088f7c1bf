"""ZIP archives of items, published by one report, and files that cannot be read as rows with their error.

An archive is written by one task as its items stream through it. Attempts of a task write files of their own names; once all
tasks are done, the driver writes the report that names the archives of the attempts that count, and removes the others. A
reader trusts the report: without one there is nothing, and a job that fails leaves none.

Files are opened by pyarrow.fs, inside tasks.
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from kinfold.functions import rules
from kinfold.operators.ordering import running
from kinfold.session import ship
from kinfold.sources.files import GLOB

#: Items of an archive.
PART_ROWS = 200
REPORT = "report.json"
ITEM = "part int, folder string, name string, content binary"
ERROR = "struct<error: string, message: string>"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """A local path may be written with any number of slashes, and is not encoded."""
    if re.match(r"file:/|/", path):
        return fs.LocalFileSystem(), re.sub(r"^(file:)?/+", "/", path)
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    parts: list[dict]


class ZipWriter(DataSourceWriter):
    def __init__(self, path: str, report: str):
        self.path, self.report, self.job = path.rstrip("/"), report, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        """Rows of ``ITEM``, those of a part one after the other. A name that a folder has already gets a number."""
        place, home = _opened(self.path)
        place.create_dir(home, recursive=True)
        attempt, done, at, sink, archive, names = uuid.uuid4().hex, [], None, None, None, set()

        def close() -> None:
            if archive:
                archive.close()
                sink.close()

        for row in iterator:
            if row.part != at:
                close()
                at, names = row.part, set()
                done.append({"part": at, "file": f"part-{at:05d}-{self.job}-{attempt}.zip", "items": 0, "bytes": 0})
                sink = place.open_output_stream(f"{home}/{done[-1]['file']}")
                archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
            name, k = row.name or "", 1
            stem, dot, ending = name.rpartition(".") if "." in name else (name, "", "")
            while (row.folder, name) in names:
                k += 1
                name = f"{stem} ({k}){dot}{ending}"
            names.add((row.folder, name))
            content = bytes(row.content or b"")
            archive.writestr(f"{row.folder}/{name}", content)
            done[-1]["items"] += 1
            done[-1]["bytes"] += len(content)
        close()
        return Written(done)

    def _clear(self, but: set[str]) -> None:
        place, home = _opened(self.path)
        for info in place.get_file_info(fs.FileSelector(home, allow_not_found=True)):
            if self.job in info.base_name and info.base_name not in but:
                place.delete_file(info.path)

    def commit(self, messages: list[Written | None]) -> None:
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: p["part"])
        place, home = _opened(self.path)
        place.create_dir(home, recursive=True)
        # Written beside, then moved: a reader sees the old report or this one.
        with place.open_output_stream(f"{home}/{self.job}.json") as out:
            out.write(json.dumps({"parts": parts, "report": self.report}).encode())
        place.move(f"{home}/{self.job}.json", f"{home}/{REPORT}")
        self._clear({p["file"] for p in parts})

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(set())


class ZipParts(DataSource):
    """The sink ``zip_parts``: rows of ``ITEM``, options path and report."""

    @classmethod
    def name(cls) -> str:
        return "zip_parts"

    def writer(self, schema, overwrite: bool) -> ZipWriter:
        return ZipWriter(self.options["path"], self.options.get("report", ""))


def write_archives(items: DataFrame, path: str, report: str = "", part_rows: int = PART_ROWS) -> None:
    """``items`` (id, folder, name, content) by folder and id, ``part_rows`` to an archive, and a report that publishes them.

    Null names are empty, null contents too; a null folder is the folder "other".
    """
    spark = items.sparkSession
    ship(spark)
    spark.dataSource.register(ZipParts)
    folder = F.coalesce("folder", F.lit("other"))
    # Contents stay out of the numbering.
    placed = running(items.select("id", folder.alias("folder"), "name", F.xxhash64("content").alias("hash")), [F.col("folder"), F.col("id"), F.col("name"), F.col("hash")])
    placed = placed.select("id", F.floor((F.col("row_no") - 1) / part_rows).cast("int").alias("part")).distinct()
    if items.groupBy("id").count().filter("count > 1 or id is null").limit(1).count():
        raise ValueError("ids of items are not unique")
    rows = items.join(placed, "id").repartition("part").sortWithinPartitions("part", "folder", "id")
    rows.select("part", folder.alias("folder"), "name", "content").write.format("zip_parts").option("path", path).option("report", report).mode("append").save()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """part, folder, name, content of the archives that the report names; raises FileNotFoundError where there is none."""
    ship(spark)
    place, home = _opened(path.rstrip("/"))
    with place.open_input_stream(f"{home}/{REPORT}") as source:
        parts = json.loads(source.read())["parts"]

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, root = _opened(path.rstrip("/"))
        for frame in frames:
            for part, file in zip(frame.part, frame.file, strict=True):
                with at.open_input_file(f"{root}/{file}") as source, zipfile.ZipFile(source) as archive:
                    for entry in archive.namelist():
                        folder, _, name = entry.partition("/")
                        yield pd.DataFrame({"part": [part], "folder": [folder], "name": [name], "content": [archive.read(entry)]})

    files = spark.createDataFrame([(p["part"], p["file"]) for p in parts], "part int, file string")
    return files.repartition(max(1, len(parts)), "part").mapInPandas(unpack, ITEM)


def read_report(path: str) -> dict:
    place, home = _opened(path.rstrip("/"))
    with place.open_input_stream(f"{home}/{REPORT}") as source:
        return json.loads(source.read())


def read_or_error(spark: SparkSession, path: str, glob: str = GLOB, decode: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """id, name, path, mime, size, modified, content, error: one row for each file below ``path`` at the time of the call.

    ``error`` (error, message) says why a file has no content: it has gone, may not be read, or ``decode`` raised. Each file is
    read in its task, one at a time. Empty files, which Spark's own source leaves out, are rows too. The names of the files pass
    through the driver, where Spark's index of them is anyway.
    """
    ship(spark)
    index = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    paths = [(unquote(p),) for p in index.inputFiles()]
    spread = max(1, min(len(paths), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = spark.createDataFrame(paths, "path string").repartition(spread, "path")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file in frame.path:
                content, error, size, modified = None, None, None, None
                try:
                    place, at = _opened(file)
                    info = place.get_file_info(at)
                    size, modified = info.size, info.mtime_ns and info.mtime_ns // 1000
                    with place.open_input_stream(at) as source:
                        content = source.read()
                    content = decode(content) if decode else content
                except Exception as e:  # noqa: BLE001 whatever a file or a decoder raises is its row's error
                    content, error = None, {"error": type(e).__name__, "message": str(e)}
                yield pd.DataFrame({"path": [file], "size": pd.array([size], "Int64"), "modified": pd.array([modified], "Int64"), "content": [content], "error": [error]})

    rows = found.mapInPandas(read, f"path string, size long, modified long, content binary, error {ERROR}")
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(F.xxhash64("path").alias("id"), name.alias("name"), "path", rules.mime_of(name).alias("mime"), "size", F.timestamp_micros("modified").alias("modified"), "content", "error")
