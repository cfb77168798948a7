"""Tables of the application and files beside them: reading, replacing by key, dropping files off, reports.

Tables are Parquet folders that a log of versions names; a job that dies before its version is in the log has changed nothing.
Defined results: a table never written is empty of rows but has its columns; repeated keys among new rows keep one row; an empty
change writes the same rows again.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The application's tables: key, and columns.
TABLES = {
    "documents": (["doc_id"], "doc_id long, title string, filename string, status string, document_type string, added_on timestamp, confirmed_on date, user_party string, is_neither boolean, identity string, full_text string, warnings array<string>"),
    "pages": (["doc_id", "page"], "doc_id long, page int, text string, source string, rotation int"),
    "facts": (["doc_id", "no"], "doc_id long, no int, kind string, text string, role string, day date, minor long, currency string, term_value int, term_unit string, origin string, verification string, confidence string, sort_index int, at int, to int, quote string"),
    "obligations": (["obligation_id"], "obligation_id long, doc_id long, category string, title string, counterparty string, direction string, amount_minor long, currency string, due_date date, status string, reminders boolean, history array<string>, completed_on date"),
    "profiles": (["name"], "name string, business string, aliases array<string>"),
}


class Conflict(RuntimeError):
    """Another writer has committed since the snapshot that a change was made from."""


@dataclass(frozen=True)
class Snapshot:
    """The tables as of one version: where each lies, and what it reads as."""

    store: Store
    version: int
    folders: dict[str, str]

    def read(self, name: str) -> DataFrame:
        if name not in self.folders:
            return self.store.spark.createDataFrame([], TABLES[name][1])
        return self.store.spark.read.parquet(f"{self.store.root}/{self.folders[name]}")


class Store:
    """The five tables below one folder, with a log of versions.

    A version is one file of the log that names the folder of every table, so that a change of several tables is seen whole or
    not at all. Its number is claimed by creating that file where none is: of two writers that began from one version the second
    gets a Conflict, and `change` makes its change again from the newer one. Folders that no kept version names are removed by
    `vacuum`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    @property
    def _files(self):
        return self._path("_log").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, name: str) -> dict[str, int]:
        """Names in a folder and when they last changed, in milliseconds."""
        files, path = self._files, self._path(name)
        return {str(s.getPath().getName()): int(s.getModificationTime()) for s in files.listStatus(path)} if files.exists(path) else {}

    def versions(self) -> list[int]:
        return sorted(int(n[: -len(".json")]) for n in self._listed("_log") if n.endswith(".json") and not n.startswith("."))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or an older one that is still kept; readers of a snapshot see nothing that is written later."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if not version:
            return Snapshot(self, 0, {})
        stream = self._files.open(self._path(f"_log/{version:020d}.json"))
        try:
            return Snapshot(self, version, json.loads(str(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))))
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        return self.snapshot().read(name)

    def _claim(self, version: int, folders: dict[str, str]) -> None:
        """Put a version into the log, whole and only if it isn't there."""
        files, target = self._files, self._path(f"_log/{version:020d}.json")
        part = self._path(f"_log/.{version}-{uuid.uuid4().hex}")
        out = files.create(part, True)
        out.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
        out.close()
        try:
            if str(files.getScheme()) == "file":  # renaming would replace what is there; linking doesn't
                local = lambda p: str(p.toUri().getPath())
                os.link(local(part), local(target))
            elif files.exists(target) or not files.rename(part, target):
                raise FileExistsError
        except FileExistsError:
            raise Conflict(f"version {version} of {self.root} is taken") from None
        finally:
            files.delete(part, False)

    def commit(self, base: Snapshot, changed: dict[str, DataFrame]) -> int:
        """The next version after `base`, with exactly these rows in the changed tables; its number. A Conflict leaves nothing behind."""
        made = {name: f"{name}/{uuid.uuid4().hex}" for name in changed}
        try:
            for name, rows in changed.items():
                rows.write.parquet(f"{self.root}/{made[name]}")
            self._claim(base.version + 1, base.folders | made)
        except BaseException:
            for folder in made.values():
                self._files.delete(self._path(folder), True)
            raise
        return base.version + 1

    def change(self, make: Callable[[Snapshot], dict[str, DataFrame]], tries: int = 5) -> int:
        """Commit what `make` gives for the newest snapshot, again from a newer one after a conflict."""
        for left in range(tries, 0, -1):
            base = self.snapshot()
            try:
                return self.commit(base, make(base))
            except Conflict:
                if left == 1:
                    raise
        raise ValueError("no tries")

    def write(self, name: str, rows: DataFrame) -> None:
        """A new version of a table with exactly these rows."""
        self.change(lambda _: {name: rows})

    def replace(self, name: str, rows: DataFrame) -> None:
        """Rows of the same key are replaced, others added."""
        self.replace_all({name: rows})

    def replace_all(self, tables: dict[str, DataFrame]) -> int:
        """As replace, for several tables in one version."""

        def make(now: Snapshot) -> dict[str, DataFrame]:
            out = {}
            for name, rows in tables.items():
                keys = TABLES[name][0]
                new = rows.dropDuplicates(keys)
                out[name] = now.read(name).join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)
            return out

        return self.change(make)

    def delete(self, ids: DataFrame) -> int:
        """Documents with their pages, facts and obligations, in one version."""
        gone = ids.select("doc_id").distinct()
        return self.change(lambda now: {name: now.read(name).join(gone, "doc_id", "left_anti") for name in ("documents", "pages", "facts", "obligations")})

    def vacuum(self, keep: int = 2, hours: float = 24.0) -> list[str]:
        """Remove all but the newest `keep` versions from the log, and folders that none of those names: at once if an older version named
        them, else (a writer may still be at work, or has died) once they are `hours` old. Returns the folders removed."""
        known = self.versions()
        dropped = known[: -keep] if keep else known[:-1]
        kept = {f for v in known[len(dropped) :] for f in self.snapshot(v).folders.values()}
        old = {f for v in dropped for f in self.snapshot(v).folders.values()}
        now = time.time() * 1000
        gone = [f"{name}/{n}" for name in TABLES for n, at in self._listed(name).items() if f"{name}/{n}" not in kept and (f"{name}/{n}" in old or now - at > hours * 3_600_000)]
        for version in dropped:
            self._files.delete(self._path(f"_log/{version:020d}.json"), False)
        for folder in gone:
            self._files.delete(self._path(folder), True)
        return sorted(gone)


def changed_ids(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, change (added, removed, changed) of the rows that differ between two states of a table, by digests of their values; repeated
    rows of a key count as one set, rows without a key as one key."""

    def digests(df: DataFrame, name: str) -> DataFrame:
        value = F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != key)), {"ignoreNullFields": "false"}), 256)
        return df.groupBy(F.col(key).alias(f"{name}_key")).agg(F.array_sort(F.collect_set(value)).alias(name))

    met = digests(before, "old").join(digests(after, "new"), F.col("old_key").eqNullSafe(F.col("new_key")), "full").withColumn(key, F.coalesce("old_key", "new_key"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return met.where(~F.col("old").eqNullSafe(F.col("new"))).select(key, kind.alias("change"))


def kept_up(before: DataFrame, after: DataFrame, derived: DataFrame, derive: Callable[[DataFrame], DataFrame], key: str = "doc_id") -> DataFrame:
    """A table derived from another row by row, after that has changed: rows of changed keys are made anew, all others are kept as they are."""
    ids = changed_ids(before, after, key).select(F.col(key).alias("_key"))
    same = lambda df: df[key].eqNullSafe(ids["_key"])
    return derived.join(ids, same(derived), "left_anti").unionByName(derive(after.join(ids, same(after), "left_semi")), allowMissingColumns=True)


def drop_name(arrived_ms, name):
    """The name of a file dropped into an inbox: when it came, then its own name without folders."""
    return F.concat(arrived_ms.cast("string"), F.lit("_"), F.regexp_replace(name, r"^.*[/\\]", ""))


def write_files(files: DataFrame, uri: str) -> DataFrame:
    """files(name, content binary): each written whole below uri from its own task, an older one of the name replaced. Returns the names."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(content.as_py() or b"")
                store.move(part, f"{root}/{name}")  # whole files only, also after a retry
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["name"])

    return files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(put, "name string")


def dropped(files: DataFrame, uri: str) -> DataFrame:
    """files(arrived_ms, name, content) dropped into an inbox folder, as `streaming.inbox` reads it."""
    return write_files(files.select(drop_name(F.col("arrived_ms"), F.col("name")).alias("name"), "content"), uri)


def delete_files(names: DataFrame, uri: str) -> DataFrame:
    """Delete the named files below uri; returns name and whether there was one."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        for batch in batches:
            had = [store.get_file_info(f"{root}/{name}").type == fs.FileType.File for name in batch.column(0).to_pylist()]
            for name, there in zip(batch.column(0).to_pylist(), had, strict=True):
                if there:
                    store.delete_file(f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(had)], names=["name", "deleted"])

    return names.select("name").mapInArrow(remove, "name string, deleted boolean")


def report(scores: DataFrame, provider: str, skipped: DataFrame) -> DataFrame:
    """One row per document of scores(doc_id, field, right, total), one per skipped (name, skipped_because), and the overall line, as
    printable text beside its values: part, name, field, score, line."""
    ratio = F.when(F.col("total") > 0, F.col("right") / F.col("total"))
    shown = lambda name, field, score: F.concat(F.rpad(name, 24, " "), F.rpad(field, 20, " "), F.coalesce(F.lpad(F.concat(F.round(score * 100).cast("int").cast("string"), F.lit("%")), 6, " "), F.lit("   n/a")))
    rows = scores.select(F.lit("document").alias("part"), F.col("doc_id").cast("string").alias("name"), "field", ratio.alias("score"))
    overall = rows.where("score is not null").groupBy("field").agg(F.avg("score").alias("score")).select(F.lit("overall").alias("part"), F.lit(provider).alias("name"), "field", "score")
    left = skipped.select(F.lit("skipped").alias("part"), "name", F.col("skipped_because").alias("field"), F.lit(None).cast("double").alias("score"))
    return rows.unionByName(overall).unionByName(left).withColumn("line", shown(F.col("name"), F.col("field"), F.col("score")))
