"""The inbox and the label files as data sources of Spark: `spark.read.format("inbox")`, `spark.readStream.format("inbox")`, `format("labels")`.

An inbox holds files named <epoch-ms>_<name>. A batch read lists it once and deals its files over tasks. A stream's offset is the set
of files that were there: a batch is what is new since the offset before, whatever the order in which files come, and files are
deleted once their batch is committed; those that a crash leaves behind are in the next offset, so they aren't read again, and go with
its commit. Offsets stay as small as the inbox.

Defined results: a file that can't be read, isn't UTF-8 or has no text gives a row with an error and no text; a name without a leading
time has no time; an empty or missing folder gives no rows; names that begin with a dot are being written and are left aside.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

ARRIVALS = "file string, name string, arrived_ms long, full_text string, error string"
LABELS = "file string, name string, label string, skipped_because string"
ENDING = ".expected.json"


def opened(path: str):
    """The file system and the folder of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def listed(path: str, ending: str = "") -> list[str]:
    from pyarrow import fs

    store, root = opened(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and not f.base_name.startswith(".") and f.base_name.endswith(ending))


def text_of(path: str, file: str) -> tuple[str | None, str | None]:
    """(text, error) of a file, whole."""
    store, root = opened(path)
    try:
        with store.open_input_stream(f"{root}/{file}", compression=None) as stream:
            content = stream.read()
    except OSError as e:
        return None, f"not readable: {type(e).__name__}"
    try:
        text = re.sub("\r\n?", "\n", content.decode())
    except UnicodeDecodeError:
        return None, "not UTF-8"
    return (text, None) if text.strip() else (None, "no text")


class Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def dealt(files: list[str], tasks: int) -> list[Files]:
    return [Files(files[i::tasks]) for i in range(max(1, min(tasks, len(files))))]


def arrivals(path: str, files: list[str]) -> Iterator[tuple]:
    for file in files:
        m = re.match(r"(\d{1,18})_(.*)", file, re.S)
        yield (file, m[2] if m else file, int(m[1]) if m else None, *text_of(path, file))


def label_rows(path: str, files: list[str]) -> Iterator[tuple]:
    for file in files:
        text, error = text_of(path, file)
        if not error:
            try:
                error = None if isinstance(json.loads(text or ""), dict) else "not a JSON object"
            except ValueError:
                error = "not readable as JSON"
        yield file, file[: -len(ENDING)], None if error else text, error


class _Reader(DataSourceReader):
    def __init__(self, options: dict, rows, ending: str = ""):
        self.path, self.tasks, self.rows, self.ending = options["path"], int(options.get("tasks", 8)), rows, ending

    def partitions(self) -> list[Files]:
        return dealt(listed(self.path, self.ending), self.tasks)

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(self.path, partition.files)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.tasks = options["path"], int(options.get("tasks", 8))
        self.deletes = options.get("delete", "true").lower() == "true"

    def initialOffset(self) -> dict:
        return {"files": []}

    def latestOffset(self) -> dict:
        return {"files": listed(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        known = set(start["files"])
        return dealt([f for f in end["files"] if f not in known], self.tasks)

    def read(self, partition: Files) -> Iterator[tuple]:
        return arrivals(self.path, partition.files)

    def commit(self, end: dict) -> None:
        store, root = opened(self.path)
        there = set(listed(self.path)) if self.deletes else set()
        for file in there.intersection(end["files"]):
            store.delete_file(f"{root}/{file}")


class InboxSource(DataSource):
    """Options: path; tasks, over how many a read is dealt (8); delete, whether a stream removes what it has committed (true)."""

    @classmethod
    def name(cls) -> str:
        return "inbox"

    def schema(self) -> str:
        return ARRIVALS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), arrivals)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


class LabelSource(DataSource):
    """Label files (<name>.expected.json) of a folder, each whole, or why it is skipped. Options: path; tasks (8)."""

    @classmethod
    def name(cls) -> str:
        return "labels"

    def schema(self) -> str:
        return LABELS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), label_rows, ENDING)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for source in (InboxSource, LabelSource):
        spark.dataSource.register(source)
