"""Cutting documents into chunks, enrichment jobs over them, and records made of their outputs."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import as_lines
from ..session import importable, spread
from ..sources.folder import Folder, lock_file

MAX_CHARS = 12_000
#: Change these with the prompt or with the rules of cutting: older answers are then no longer reused.
PROMPT_VERSION = CHUNK_VERSION = 1
RULE = "struct<text:string,start_line:int,end_line:int,excerpt:string>"
OUTPUT = f"struct<summary:string,topics:array<string>,aliases:array<string>,questions:array<string>,rules:array<{RULE}>>"
#: Limits on what a model's answer may hold.
SUMMARY_MAX, LIST_MAX, RULES_MAX, RULE_MAX, EXCERPT_MAX, RECORD_SUMMARY_MAX = 800, 12, 20, 400, 300, 1200


def ranges(lines: Column, limit: int = MAX_CHARS) -> Column:
    """(start_line, end_line) of each chunk, greedily by lines.

    A chunk is closed before a line that would overfill it, or before a heading once it is half full; never within
    fenced code or a table.  A line that is too long alone stays whole.
    """
    span = "struct<start_line:int,end_line:int>"
    start = F.struct(
        F.array().cast(f"array<{span}>").alias("done"), F.lit(1).alias("start"), F.lit(0).cast("long").alias("chars"), F.lit("").alias("fence"), F.lit(0).alias("n")
    )

    def step(acc: Column, line: Column) -> Column:
        trimmed = F.regexp_replace(line, r"^\s+|\s+$", "")
        mark = F.regexp_extract(trimmed, "^(```|~~~)", 1)
        before = acc["fence"]
        fence = F.when(mark == "", before).when(before == "", mark).when(before == mark, F.lit("")).otherwise(before)
        free = (before == "") & (fence == "") & ~line.rlike(r"^\s*\|")
        size = F.length(line).cast("long") + 1
        heading = trimmed.rlike(r"^#{1,6}\s+\S")
        n = acc["n"] + 1
        full = (acc["chars"] + size > limit) & (n > acc["start"])
        cut = (n > 1) & free & (full | (heading & (acc["chars"] > limit / 2)))
        one = F.array(F.struct(acc["start"].alias("start_line"), (n - 1).alias("end_line")))
        return F.struct(
            F.when(cut, F.concat(acc["done"], one)).otherwise(acc["done"]).alias("done"),
            F.when(cut, n).otherwise(acc["start"]).alias("start"),
            F.when(cut, size).otherwise(acc["chars"] + size).alias("chars"),
            fence.alias("fence"),
            n.alias("n"),
        )

    last = lambda acc: F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start_line"), F.greatest(acc["n"], F.lit(1)).alias("end_line"))))
    return F.aggregate(lines, start, step, last)


def chunks(docs: DataFrame, key: str = "doc_id", limit: int = MAX_CHARS) -> DataFrame:
    """``key``, idx, start_line, end_line, and the other columns of ``docs`` but its text."""
    lines = F.col("lines") if "lines" in docs.columns else as_lines(F.col("text"))
    keep = [c for c in docs.columns if c not in ("text", "lines")]
    return spread(docs).select(*keep, F.posexplode(ranges(lines, limit)).alias("idx", "r")).select(*keep, "idx", "r.start_line", "r.end_line")


def with_text(parts: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks with their lines joined."""
    lines = F.col("lines") if "lines" in docs.columns else as_lines(F.col("text"))
    body = F.array_join(F.slice("_lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return parts.join(spread(docs).select(key, lines.alias("_lines")), key).withColumn("text", body).drop("_lines")


def reuse(previous: DataFrame, following: DataFrame) -> DataFrame:
    """New chunks with the output of a completed one: same path, hash, place and lines, else the same without a path."""
    place = ["source_hash", "idx", "start_line", "end_line"]
    done = previous.filter("status = 'completed'").select("rel_path", *place, "output")
    exact = done.filter("rel_path is not null").dropDuplicates(["rel_path", *place]).withColumnRenamed("output", "_exact")
    loose = done.filter("rel_path is null").dropDuplicates(place).drop("rel_path").withColumnRenamed("output", "_loose")
    both = following.join(exact, ["rel_path", *place], "left").join(loose, place, "left")
    output = F.coalesce("_exact", "_loose")
    keep = [c for c in following.columns if c not in ("status", "output")]
    return both.select(*keep, F.when(output.isNotNull(), F.lit("completed")).otherwise(F.lit("pending")).alias("status"), output.alias("output"))


def job_summary(parts: DataFrame, by: str = "root", paused: Column | None = None) -> DataFrame:
    """total, done, failed, pending, percent and state of each job."""
    paused = F.lit(False) if paused is None else paused
    out = parts.groupBy(by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "completed").alias("done"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status").isin("pending", "running")).alias("pending"),
    )
    state = F.when(paused & (F.col("pending") > 0), "paused").when((F.col("pending") == 0) & (F.col("failed") == 0), "complete").when(F.col("pending") == 0, "partly complete").otherwise("running")
    return out.withColumn("percent", F.floor(100 * F.col("done") / F.col("total") + 0.5).cast("int")).withColumn("state", state)


def merge_outputs(parts: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """A record of each document all of whose chunks are completed for its present hash.

    Lists are united in the order of chunks, rules follow each other, summaries are joined.
    """
    current = parts.join(docs.select(key, F.col("source_hash").alias("_now")), key)
    good = (F.col("status") == "completed") & F.col("output").isNotNull() & (F.col("source_hash") == F.col("_now"))
    ordered = F.array_sort(F.collect_list(F.struct("idx", "start_line", "end_line", "output")))
    whole = current.groupBy(key).agg(F.bool_and(good).alias("_all"), ordered.alias("_parts"), F.first("_now").alias("source_hash")).filter("_all")
    each = lambda f: F.transform("_parts", lambda p: F.coalesce(p["output"][f], F.array().cast(f"array<{'string' if f != 'rules' else RULE}>")))
    united = lambda f: F.array_distinct(F.flatten(each(f)))
    summary = F.array_join(F.filter(F.transform("_parts", lambda p: p["output"]["summary"]), lambda s: s.isNotNull() & (s != "")), "\n")
    return whole.select(
        key,
        "source_hash",
        F.substring(summary, 1, RECORD_SUMMARY_MAX).alias("summary"),
        *(united(f).alias(f) for f in ("topics", "aliases", "questions")),
        F.flatten(each("rules")).alias("rules"),
        F.transform("_parts", lambda p: F.struct(p["start_line"].alias("start_line"), p["end_line"].alias("end_line"))).alias("coverage"),
    )


#: The headings and fillers of a derived note.
NOTE_TEXTS = {"summary": "## Summary", "rules": "## Rules found in the source", "names": "## Other names and questions", "aliases": "Names:", "questions": "Questions that lead here:", "none": "(none)"}


def derived_body(summary: Column, rules: Column, aliases: Column, questions: Column) -> Column:
    """The markdown body of a note that is derived from a record."""
    none = F.lit(NOTE_TEXTS["none"])
    listed = lambda x: F.when(F.size(x) > 0, F.array_join(x, "\n")).otherwise(none)
    bullets = lambda x: listed(F.transform(x, lambda y: F.concat(F.lit("- "), y)))
    told = F.transform(rules, lambda r: F.concat(F.lit("- "), r["text"], F.format_string(" (lines %d to %d)\n  ", r["start_line"], r["end_line"]), r["excerpt"]))
    title = lambda k: F.lit(NOTE_TEXTS[k])
    parts = [title("summary"), F.when(summary != "", summary).otherwise(none), F.lit(""), title("rules"), listed(told), F.lit(""), title("names"), title("aliases"), bullets(aliases), F.lit(""), title("questions"), bullets(questions)]
    return F.concat_ws("\n", *parts)


def extract_json(answer: str) -> object:
    """What stands from the first brace to the last."""
    a, b = answer.find("{"), answer.rfind("}")
    if a < 0 or b <= a:
        raise ValueError("not-json")
    return json.loads(answer[a : b + 1])


def _strings(raw: object) -> list[str]:
    return [x.strip() for x in raw if isinstance(x, str) and x.strip()][:LIST_MAX] if isinstance(raw, list) else []


def _whole(raw: object) -> int:
    if isinstance(raw, bool) or not re.fullmatch(r"\s*-?\d+(\.0*)?\s*", str(raw)):
        raise ValueError("a rule's fields aren't valid")
    return int(float(raw))  # type: ignore[arg-type]


def validate(raw: object, text: str, start_line: int, end_line: int) -> dict:
    """The answer within its limits; one bad rule fails the chunk.  ``text`` is the chunk's."""
    if not isinstance(raw, dict):
        raise ValueError("the answer isn't an object")
    lines, rules = text.split("\n"), []
    listed = raw.get("rules")
    for rule in listed[:RULES_MAX] if isinstance(listed, list) else []:
        if not isinstance(rule, dict):
            continue
        told, excerpt = (str(rule.get(k) or "").strip() if isinstance(rule.get(k), str) else "" for k in ("text", "excerpt"))
        first, last = _whole(rule.get("startLine")), _whole(rule.get("endLine"))
        if not told or not excerpt:
            raise ValueError("a rule's fields aren't valid")
        if first < start_line or last > end_line or first > last:
            raise ValueError("a rule's lines lie outside the chunk")
        if excerpt not in "\n".join(lines[first - start_line : last - start_line + 1]):
            raise ValueError("an excerpt doesn't stand in its lines")
        rules.append({"text": told[:RULE_MAX], "start_line": first, "end_line": last, "excerpt": excerpt[:EXCERPT_MAX]})
    summary = raw.get("summary")
    return {"summary": summary.strip()[:SUMMARY_MAX] if isinstance(summary, str) else "", **{k: _strings(raw.get(k)) for k in ("topics", "aliases", "questions")}, "rules": rules}


Complete = Callable[[str, str | None], str]


def ask(complete: Complete, text: str, start_line: int, end_line: int, retries: int) -> tuple[str, str | None, dict | None, int, bool]:
    """(status, error, output, requests, whether the last call itself failed); a retry is told what was wrong."""
    error, threw = None, False
    for attempt in range(1 + retries):
        try:
            threw = True
            answer = complete(text, error)
            threw = False
            return "completed", None, validate(extract_json(answer), text, start_line, end_line), attempt + 1, False
        except Exception as e:  # noqa: BLE001 - whatever a model or its answer does
            error = str(e) or type(e).__name__
    return "failed", error, None, 1 + retries, threw


def enrich(parts: DataFrame, complete: Complete, retries: int = 2, concurrency: int = 8, pause_after: int | None = None) -> DataFrame:
    """Chunks (with text) through a model: status, error, output, requests, threw.  ``concurrency`` calls run at once.

    Once ``pause_after`` chunks in a row whose calls failed themselves, a task leaves the rest of its chunks pending.
    """
    own = ("status", "output", "error", "requests", "threw")
    keep = [f.name for f in parts.schema if f.name not in own]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema if f.name not in own)
    importable(parts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failing = 0
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                if pause_after and failing >= pause_after:
                    rows.append(("pending", None, None, 0, False))
                    continue
                rows.append(ask(complete, r.text, r.start_line, r.end_line, retries))
                failing = failing + 1 if rows[-1][4] else 0
            more = pd.DataFrame(rows, columns=["status", "error", "output", "requests", "threw"], index=batch.index)
            yield pd.concat([batch[keep], more], axis=1)

    return parts.repartition(concurrency).mapInPandas(run, f"{schema}, status string, error string, output {OUTPUT}, requests int, threw boolean")


class JobBusy(RuntimeError):
    pass


class Job:
    """A resumable job over chunks; what is completed is never asked again.

    ``run`` writes the chunks that are left once, in order and cut into slices of ``batch``; each slice is one
    pass over its own rows, and its results are a written table, the checkpoint.  Answers to other prompts or of
    other cuts lie in another folder and aren't reused.  ``pause_after`` chunks in a row whose calls failed themselves
    pause the job, within a task at once.  One run at a time holds the job's lock.
    """

    def __init__(self, folder: str, complete: Complete, retries: int = 2, concurrency: int = 8, batch: int = 256, pause_after: int = 2, full: bool = False):
        self.folder = f"{folder.rstrip('/')}/prompt={PROMPT_VERSION}-chunk={CHUNK_VERSION}"
        self.complete, self.retries, self.concurrency, self.batch, self.pause_after, self.full = complete, min(8, max(0, retries)), min(32, max(1, concurrency)), batch, pause_after, full
        self.paused = self.stopped = False

    def results(self, spark: SparkSession) -> DataFrame | None:
        """All results so far, a row for each time that a chunk was asked."""
        folder = Folder(spark, self.folder)
        return spark.read.option("recursiveFileLookup", "true").parquet(folder.path("results")) if folder.names("results") else None

    def state(self, parts: DataFrame, key: list[str]) -> DataFrame:
        """``parts`` with the status and output of each chunk."""
        done = self.results(parts.sparkSession)
        if done is None:
            return parts.withColumns({"status": F.lit("pending"), "output": F.lit(None).cast(OUTPUT)})
        latest = done.groupBy(*key).agg(F.max_by(F.struct("status", "output"), F.col("status") == "completed").alias("_r"))
        return parts.join(latest, key, "left").select("*", F.coalesce("_r.status", F.lit("pending")).alias("status"), F.col("_r.output").alias("output")).drop("_r")

    def run(self, parts: DataFrame, key: list[str]) -> DataFrame:
        """``parts`` with text; ``key`` names a chunk.  Returns each chunk's latest result, or pending ones."""
        spark, folder = parts.sparkSession, Folder(parts.sparkSession, self.folder)
        with lock_file(folder, "lock", JobBusy):
            if self.full:
                folder.delete("results")
            done = self.results(spark)
            left = parts if done is None else parts.join(done.filter("status = 'completed'").select(*key).distinct(), key, "left_anti")
            name = f"{time.time_ns()}"
            n = int(spark.conf.get("spark.sql.shuffle.partitions"))
            ordered = left.repartitionByRange(n, *key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id())
            row = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
            sliced = ordered.withColumn("_slice", F.concat_ws("-", F.lpad(F.shiftright("_at", 33).cast("string"), 9, "0"), F.lpad(F.floor(row / self.batch).cast("string"), 12, "0")))
            sliced.drop("_at").write.partitionBy("_slice").parquet(folder.path("todo", name))
            failing = 0
            for part in [x for x in folder.names("todo", name) if x.startswith("_slice=")]:
                if self.paused or self.stopped:
                    break
                rows = spark.read.schema(left.schema).parquet(folder.path("todo", name, part))
                path = folder.path("results", f"{name}-{part.split('=')[1]}")
                enrich(rows, self.complete, self.retries, self.concurrency, self.pause_after).filter("status <> 'pending'").write.parquet(path)
                r = spark.read.parquet(path).agg(F.count_if("threw").alias("threw"), F.count_if(F.col("status") == "completed").alias("done")).first()
                failing = failing + r.threw if not r.done else 0
                self.paused = failing >= self.pause_after
            folder.delete("todo", name)
        return self.state(parts, key)
