"""A versioned inverted index in Parquet, made of segments.

A commit writes one new segment: the documents it brings, their postings, and the ids it changes or deletes.
Nothing that is there is read for it but the ids in the changed documents' buckets, and nothing is rewritten.  A
row of a segment is live unless a later segment names its document, so readers take the rows of a query's terms
from each segment and drop what later segments (the small ones) name.  Segments are merged when the newer one
has come near the older one in size, so a document is rewritten a logarithmic number of times.

Each segment cuts its tables into buckets by hash, as many as its size asks for.  A generation is a manifest that
names segments; readers follow one manifest, so they see one state whatever is committed meanwhile.  The pointer to
the current manifest is swapped by an atomic rename.  All paths go through Hadoop's file systems.
"""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bucket_of
from .folder import Folder, lock_file

VERSION = 2
DOCS = "doc_id string, rel_path string, path string, kind string, title string, catalog array<string>, source_hash string, source_path string, source_file_hash string, scope struct<kind:string,projects:array<string>>, mtime_ms double, size long, fingerprint string"
TERMS = "term string, doc_id string, tf long, fields array<string>, lines array<int>"
CHANGED = "doc_id string"
#: Documents in a bucket, and the most buckets of a segment.
PER_BUCKET, MOST_BUCKETS = 2048, 4096
#: A segment is merged into the one before it once it has this share of its size.
MERGE = 0.5


class IndexBusy(RuntimeError):
    pass


@dataclass
class Segment:
    number: int
    buckets: int
    docs: int
    changed: int


@dataclass
class Generation:
    generation: int
    source_key: str
    created_at: float
    segments: list[Segment] = field(default_factory=list)
    doc_count: int = 0
    complete: bool = False
    version: int = VERSION


class IndexStore:
    def __init__(self, spark: SparkSession, folder: str, source_key: str, per_bucket: int = PER_BUCKET):
        self.spark, self.folder, self.source_key, self.per_bucket = spark, Folder(spark, folder), source_key, per_bucket

    def _json(self, *parts: str) -> dict | None:
        try:
            value = json.loads(self.folder.read(*parts) or "")
        except ValueError:
            return None
        return value if isinstance(value, dict) and value.get("version") == VERSION else None

    def pointer(self) -> dict | None:
        return self._json("manifest.json")

    def generation(self, number: int | None = None) -> Generation | None:
        """A generation's manifest; one that is gone or broken falls back to the current one."""
        top = self.pointer()
        if top is None:
            return None
        for n in dict.fromkeys([number if number is not None else top["current"], top["current"]]):
            raw = self._json("generations", f"{n}.json")
            try:
                if raw and raw["source_key"] == self.source_key:
                    return Generation(**{**raw, "segments": [Segment(**s) for s in raw["segments"]]})
            except (KeyError, TypeError):
                continue
        return None

    def _segment(self, kind: str, segment: Segment, of: list[str] | None = None) -> DataFrame:
        """A table of a segment, of the buckets of the keys ``of`` alone if they are given."""
        schema = {"docs": DOCS, "terms": TERMS, "changed": CHANGED}[kind]
        base = ("segments", str(segment.number), kind)
        there = {int(x.split("=")[1]) for x in self.folder.names(*base) if x.startswith("bucket=")}
        wanted = there if of is None else there & {int(hashlib.sha256(v.encode()).hexdigest()[:8], 16) % segment.buckets for v in of}
        paths = [self.folder.path(*base, f"bucket={b}") for b in sorted(wanted)]
        if wanted and wanted == there:
            return self.spark.read.schema(schema).parquet(self.folder.path(*base)).drop("bucket")
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _live(self, kind: str, segments: list[Segment], of: list[str] | None = None, filters=None) -> DataFrame:
        """The rows of ``kind`` that no later segment replaces; ``filters`` is applied before that is looked up."""
        out = None
        for i, segment in enumerate(segments):
            rows = self._segment(kind, segment, of)
            rows = rows if filters is None else rows.filter(filters)
            later = None
            for s in segments[i + 1 :]:
                if s.changed:
                    ids = self._segment("changed", s)
                    later = ids if later is None else later.unionByName(ids)
            rows = rows if later is None else rows.join(later, "doc_id", "left_anti").select(rows.columns)
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], {"docs": DOCS, "terms": TERMS}[kind]) if out is None else out

    def _segments(self, generation: int | None) -> list[Segment]:
        g = self.generation(generation)
        return g.segments if g else []

    def docs(self, generation: int | None = None) -> DataFrame:
        return self._live("docs", self._segments(generation))

    def doc_ids(self, generation: int | None = None) -> DataFrame:
        return self.docs(generation).select("doc_id")

    def get_docs(self, ids: list[str], generation: int | None = None) -> DataFrame:
        """Only the buckets of ``ids`` are read."""
        return self._live("docs", self._segments(generation), ids, F.col("doc_id").isin(*ids))

    def get_postings(self, terms: list[str], generation: int | None = None) -> DataFrame:
        """Only the buckets of ``terms`` are read."""
        return self._live("terms", self._segments(generation), terms, F.col("term").isin(*terms))

    def postings(self, generation: int | None = None) -> DataFrame:
        return self._live("terms", self._segments(generation))

    def lock(self):
        """One writer."""
        return lock_file(self.folder, "lock", IndexBusy)

    def _write(self, number: int, buckets: int, **tables: DataFrame) -> None:
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        for kind, rows in tables.items():
            key = "term" if kind == "terms" else "doc_id"
            rows = rows.withColumn("bucket", bucket_of(F.col(key), buckets))
            # Salted by document, so that a very frequent term doesn't make one task; few buckets need few files.
            tasks = max(1, min(n, 4 * buckets))
            dealt = rows.coalesce(1) if buckets == 1 else rows.repartition(tasks, "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(4)))
            dealt.sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(self.folder.path("segments", str(number), kind))

    def _buckets_for(self, docs: int) -> int:
        n = 1
        while n < MOST_BUCKETS and n * self.per_bucket < docs:
            n *= 2
        return n

    def _number(self) -> int:
        return max([0, *(int(x) for x in self.folder.names("segments") if x.isdigit())]) + 1

    def _merge(self, segments: list[Segment]) -> list[Segment]:
        """Merge the last segment into the one before it while it has come near that in size."""
        while len(segments) > 1 and max(segments[-1].docs, segments[-1].changed) >= MERGE * max(segments[-2].docs, 1):
            pair, number, first = segments[-2:], self._number(), len(segments) == 2
            docs = self._live("docs", pair)
            changed = self._segment("changed", pair[0]).unionByName(self._segment("changed", pair[1])).distinct()
            changed = changed.limit(0) if first else changed  # there is nothing before it that could be replaced
            buckets = self._buckets_for(pair[0].docs + pair[1].docs)
            self._write(number, buckets, docs=docs, terms=self._live("terms", pair), changed=changed)
            made = Segment(number, buckets, 0, 0)
            made.docs, made.changed = self._segment("docs", made).count(), self._segment("changed", made).count()
            segments = [*segments[:-2], made]
        return segments

    def stage(self, docs: DataFrame | None, terms: DataFrame | None, deletes: DataFrame | None = None, complete: bool = True) -> Generation:
        """Write a new segment; the pointer still names the old state.

        ``docs`` (DOCS) and their ``terms`` (TERMS) replace what the index has of these documents; ``deletes`` has doc_id.
        """
        top = self.pointer()
        if top and top["source_key"] != self.source_key:
            raise ValueError("the index belongs to another source")
        old = self.generation()
        docs = self.spark.createDataFrame([], DOCS) if docs is None else docs.select(*(f.split()[0] for f in DOCS.split(", ")))
        terms = self.spark.createDataFrame([], TERMS) if terms is None else terms.select(*(f.split()[0] for f in TERMS.split(", ")))
        ids = docs.select("doc_id")
        changed = (ids if deletes is None else ids.unionByName(deletes.select("doc_id"))).distinct().persist()
        try:
            n = changed.count()
            if old and not n and old.complete == complete:
                return old
            segments, count = list(old.segments) if old else [], old.doc_count if old else 0
            if n:
                buckets, number = self._buckets_for(n), self._number()
                before = self._replaced(segments, changed)
                self._write(number, buckets, docs=docs, terms=terms, changed=changed if segments else changed.limit(0))
                made = Segment(number, buckets, 0, n if segments else 0)
                made.docs = self._segment("docs", made).count()
                count += made.docs - before
                segments = self._merge([*segments, made])
            numbers = [int(x[:-5]) for x in self.folder.names("generations") if x.endswith(".json") and x[:-5].isdigit()]
            made = Generation(max([0, *numbers]) + 1, self.source_key, time.time(), segments, count, complete)
            self.folder.write(json.dumps(asdict(made)), "generations", f"{made.generation}.json")
            return made
        finally:
            changed.unpersist()

    def _replaced(self, segments: list[Segment], changed: DataFrame) -> int:
        """How many of the ids are live now; of a few only their buckets are read."""
        if not segments:
            return 0
        few = [r.doc_id for r in changed.limit(1025).collect()]
        live = self._live("docs", segments, few, F.col("doc_id").isin(*few)) if len(few) <= 1024 else self._live("docs", segments)
        return live.select("doc_id").join(changed, "doc_id", "left_semi").count()

    def activate(self, made: Generation) -> None:
        top = self.pointer()
        if top is None or top["current"] != made.generation:
            self.folder.write(json.dumps({"version": VERSION, "source_key": self.source_key, "current": made.generation, "previous": top["current"] if top else None, "updated_at": time.time()}), "manifest.json")
        self.collect_garbage()

    def commit(self, docs: DataFrame | None, terms: DataFrame | None, deletes: DataFrame | None = None, complete: bool = True) -> Generation:
        with self.lock():
            made = self.stage(docs, terms, deletes, complete)
            self.activate(made)
            return made

    def collect_garbage(self) -> None:
        """Remove what neither the current nor the previous generation names; what is staged above them stays."""
        top = self.pointer()
        keep = [g for g in (self.generation(top["current"]), self.generation(top["previous"]) if top["previous"] is not None else None) if g]
        used, newest = {s.number for g in keep for s in g.segments}, max(g.generation for g in keep)
        for name in self.folder.names("generations"):
            if name.endswith(".json") and int(name[:-5]) not in {g.generation for g in keep} and int(name[:-5]) < newest:
                self.folder.delete("generations", name)
        bound = max(used, default=0)
        for name in self.folder.names("segments"):
            if int(name) not in used and int(name) < bound:
                self.folder.delete("segments", name)
