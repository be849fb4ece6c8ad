"""Listing folders of text and reading what is safe to read.

Listing is the driver's work (names only, within a budget), or for large roots the executors' (``spread_listing``);
contents are read by the executors, so the folders must be mounted on all of them.
"""

from __future__ import annotations

import os
import stat
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import FILE_MAX, STATE_FOLDER, TEXT_EXTENSIONS, skip_reason
from ..session import importable, scratch_path

#: Folders that are never entered, besides the state folder.
SKIP_FOLDERS = (".git", ".obsidian", "node_modules")
LISTING = "root string, rel_path string, path string, size long, mtime_ms double"


@dataclass
class Budget:
    """What a walk may use; reasons are distinct, at most eight."""

    seconds: float = 120.0
    entries: int = 1_000_000
    bytes: int = 1 << 30
    cancelled: Callable[[], bool] = lambda: False
    skipped: int = 0
    truncated: bool = False
    reasons: list[str] = field(default_factory=list)
    _began: float = field(default_factory=time.monotonic)

    def skip(self, reason: str) -> None:
        self.skipped += 1
        self.note(reason)

    def note(self, reason: str) -> None:
        if reason not in self.reasons and len(self.reasons) < 8:
            self.reasons.append(reason)

    def stop(self) -> bool:
        over = "cancelled" if self.cancelled() else "time" if time.monotonic() - self._began > self.seconds else "entries" if self.entries < 0 else "bytes" if self.bytes < 0 else ""
        if over:
            self.truncated = True
            self.note(over)
        return bool(over)


def inside(path: str, folder: str) -> bool:
    return path == folder or path.startswith(folder.rstrip("/") + "/")


def is_excluded(rel: str, rules: list[str]) -> bool:
    rel = rel.replace("\\", "/").lstrip("/")
    return any(r and inside(rel, r) for r in (x.replace("\\", "/").strip("/") for x in rules))


def walk(root: str, budget: Budget, skip_inside: list[str] = (), exclude: list[str] = ()) -> Iterator[tuple[str, str, int, float]]:
    """(relative path, path, size, mtime in ms) of text files; links and skipped folders aren't followed."""
    base, stack = os.path.realpath(root), [os.path.realpath(root)]
    while stack and not budget.stop():
        folder = stack.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            budget.skip("unreadable-folder")
            continue
        for e in entries:
            budget.entries -= 1
            if budget.stop():
                return
            rel = os.path.relpath(e.path, base).replace(os.sep, "/")
            if e.is_symlink() or any(inside(e.path, s) for s in skip_inside) or is_excluded(rel, list(exclude)):
                continue
            if e.is_dir():
                if e.name not in SKIP_FOLDERS and e.name != STATE_FOLDER:
                    stack.append(e.path)
            elif os.path.splitext(e.name)[1].lower() in TEXT_EXTENSIONS and stat.S_ISREG((st := e.stat()).st_mode):
                if st.st_size > FILE_MAX:
                    budget.skip("too-large")
                    continue
                budget.bytes -= st.st_size
                yield rel, e.path, st.st_size, st.st_mtime_ns / 1e6


def skip_inside(root: str, writable: str | None, is_writable: bool, prepare: bool = False) -> list[str]:
    """Folders below ``root`` that a walk leaves out: its own state, and a writable root nested in it."""
    out = [os.path.join(root, STATE_FOLDER)]
    if is_writable and prepare:
        out += [os.path.join(root, "digests"), os.path.join(root, "lessons")]
    if writable and writable != root and inside(writable, root):
        out.append(writable)
    return out


def listing(spark: SparkSession, name: str, root: str, budget: Budget | None = None, **options) -> DataFrame:
    rows = [(name, *x) for x in walk(root, budget or Budget(), **options)]
    return spark.createDataFrame(rows, LISTING)


_FOUND = "kind string, rel_path string, path string, size long, mtime_ms double, reason string"


def _list_folders(base: str, skip_inside: list[str], exclude: list[str]):
    """For each folder its text files, its folders, what is skipped, and how many entries it has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for folder in batch["path"]:
                try:
                    entries = sorted(os.scandir(folder), key=lambda e: e.name)
                except OSError:
                    rows.append(("skip", None, folder, None, None, "unreadable-folder"))
                    continue
                rows.append(("entries", None, folder, len(entries), None, None))
                for e in entries:
                    rel = os.path.relpath(e.path, base).replace(os.sep, "/")
                    if e.is_symlink() or any(inside(e.path, s) for s in skip_inside) or is_excluded(rel, exclude):
                        continue
                    if e.is_dir():
                        if e.name not in SKIP_FOLDERS and e.name != STATE_FOLDER:
                            rows.append(("folder", rel, e.path, None, None, None))
                    elif os.path.splitext(e.name)[1].lower() in TEXT_EXTENSIONS and stat.S_ISREG((st := e.stat()).st_mode):
                        large = st.st_size > FILE_MAX
                        rows.append(("skip", rel, e.path, None, None, "too-large") if large else ("file", rel, e.path, st.st_size, st.st_mtime_ns / 1e6, None))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _FOUND.split(", ")])

    return run


def spread_listing(spark: SparkSession, name: str, root: str, budget: Budget | None = None, skip_inside: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """The same listing made by the executors, a level of folders at a time, each level a written table.

    The driver holds counts only.  The budget is looked at between levels, so a walk may exceed it by one level.
    """
    importable(spark)
    budget, base = budget or Budget(), os.path.realpath(root)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, parts = spark.createDataFrame([(base,)], "path string"), []
    while not budget.stop():
        path = scratch_path(spark, "listing")
        found = folders.repartition(n, "path").mapInPandas(_list_folders(base, list(skip_inside), list(exclude)), _FOUND)
        found.write.parquet(path)
        level = spark.read.schema(_FOUND).parquet(path)
        size = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("size"))), F.lit(0))
        r = level.agg(size("entries").alias("entries"), size("file").alias("bytes"), F.count("reason").alias("skipped"), F.collect_set("reason").alias("reasons"), F.count_if(F.col("kind") == "folder").alias("folders")).first()
        budget.entries, budget.bytes, budget.skipped = budget.entries - r.entries, budget.bytes - r.bytes, budget.skipped + r.skipped
        for reason in sorted(r.reasons):
            budget.note(reason)
        parts.append(level.filter("kind = 'file'").select(F.lit(name).alias("root"), "rel_path", "path", "size", "mtime_ms"))
        folders = level.filter("kind = 'folder'").select("path")
        if not r.folders:
            budget.stop()
            break
    out = spark.createDataFrame([], LISTING)
    for part in parts:
        out = out.unionByName(part)
    return out


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        contents = []
        for path in batch["path"]:
            try:
                flags = os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0)
                with os.fdopen(os.open(path, flags), "rb") as f:
                    contents.append(f.read(FILE_MAX + 1))
            except OSError:
                contents.append(None)
        yield batch.assign(content=contents)


def read_contents(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """Adds content (null: unreadable) and reason (null: readable text)."""
    importable(files.sparkSession)
    spread = files.repartition(partitions or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    read = spread.mapInPandas(_read, f"{schema}, content binary")
    return read.withColumn("reason", F.when(F.col("content").isNull(), F.lit("unreadable")).otherwise(skip_reason(F.col("content"))))


def read_texts(files: DataFrame) -> DataFrame:
    """Files with text and source_hash, or with the reason why they have none."""
    read, good = read_contents(files), F.col("reason").isNull()
    return read.withColumns({"text": F.when(good, F.decode("content", "UTF-8")), "source_hash": F.when(good, F.sha2("content", 256))}).drop("content")


def text_files(files: DataFrame) -> DataFrame:
    """Readable files with text and source_hash."""
    return read_texts(files).filter("reason is null").drop("reason")


def within_bytes(files: DataFrame, most: int, order: str = "rel_path") -> DataFrame:
    """Files in ``order`` whose sizes add up to at most ``most``.

    Prefix sums in two steps: within range partitions, then over one total per partition.
    """
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = files.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id())
    within = placed.withColumn("_sum", F.sum("size").over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    totals = placed.groupBy("_part").agg(F.sum("size").alias("_total"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return within.join(F.broadcast(before), "_part").filter(F.col("_sum") + F.col("_before") <= most).drop("_part", "_sum", "_before")


def changes(previous: DataFrame, now: DataFrame, key: str = "rel_path") -> DataFrame:
    """``key`` and status of a listing against the last one: insert, update, delete, same, or check.

    Equal size, time and fingerprint are the same file; otherwise the hash decides, and where ``now`` has none yet
    the status is ``check``.
    """
    p, n = previous.alias("p"), now.alias("n")
    both = p.join(n, F.col(f"p.{key}") == F.col(f"n.{key}"), "full_outer")
    stat_same = (F.col("p.size") == F.col("n.size")) & (F.col("p.mtime_ms") == F.col("n.mtime_ms")) & F.col("p.fingerprint").eqNullSafe(F.col("n.fingerprint"))
    hashed = F.col("n.source_hash") if "source_hash" in now.columns else F.lit(None).cast("string")
    meta_same = F.col("p.fingerprint").eqNullSafe(F.col("n.fingerprint"))
    status = (
        F.when(F.col(f"p.{key}").isNull(), "insert").when(F.col(f"n.{key}").isNull(), "delete").when(stat_same, "same").when(hashed.isNull(), "check").when((hashed == F.col("p.source_hash")) & meta_same, "same").otherwise("update")
    )
    return both.select(F.coalesce(f"p.{key}", f"n.{key}").alias(key), status.alias("status"))


def skip_summary(skipped: DataFrame, by: str = "root", most: int = 8) -> DataFrame:
    """Number of skipped files and their distinct reasons, at most eight."""
    return skipped.filter("reason is not null").groupBy(by).agg(F.count("*").alias("skipped"), F.slice(F.array_sort(F.collect_set("reason")), 1, most).alias("reasons"))
