"""The engine: indexing roots, searching them, writing notes, enrichment, and a status report."""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STATE_FOLDER, choose_title, doc_key, is_ai_note, is_truncated_read, note_lines, read_reference, secret_kind
from ..functions.tokens import needles, parse_query, query_terms
from ..operators import chunks, notes, ownership, search
from ..operators.postings import postings
from ..session import importable
from ..sources import config as configs
from ..sources import files
from ..sources.folder import Folder
from ..sources.index_store import DOCS, IndexBusy, IndexStore

BODY_MAX, TITLE_MAX, OUTPUT_MAX, OUTPUT_LINES = 16 * 1024, 120, 12 * 1024, 400
SNAPSHOT_VERSION = 1
HITS = f"path string, kind string, score double, partial boolean, title string, root string, rel_path string, catalog array<string>, source_path string, scope {notes.SCOPE}, snippets array<struct<line:int,text:string>>, preview string, semantic boolean, evidence string"


@dataclass
class Report:
    """What a search could not see."""

    truncated: bool = False
    skipped: int = 0
    skip_reasons: list[str] = field(default_factory=list)

    def add(self, truncated: bool, skipped: int, reasons: list[str]) -> None:
        self.truncated, self.skipped = self.truncated or truncated, self.skipped + skipped
        self.skip_reasons += [r for r in dict.fromkeys(reasons) if r not in self.skip_reasons][: 8 - len(self.skip_reasons)]


@dataclass
class Result:
    hits: DataFrame
    truncated: bool = False
    skipped: int = 0
    skip_reasons: list[str] = field(default_factory=list)

    def text(self) -> str:
        """At most 12 KiB and 400 lines."""
        rows = self.hits.collect()
        out = [f"truncated: {self.truncated}", f"skipped: {self.skipped}" + (f" ({', '.join(self.skip_reasons)})" if self.skip_reasons else ""), f"hits: {len(rows)}"]
        for i, r in enumerate(rows, 1):
            out.append(f"{i}. [{r.kind}] {r.title or r.rel_path} - {r.path}" + (" (partial)" if r.partial else ""))
            out += [f"   L{s.line}: {s.text}" for s in r.snippets] or [f"   {r.preview or ''}"]
            out += [f"   matched by meaning: {r.evidence or ''}"] * r.semantic
        return "\n".join(out[:OUTPUT_LINES]).encode()[:OUTPUT_MAX].decode(errors="ignore")


class Prepared(NamedTuple):
    """A root's documents with their lines: created, updated, reused or (not written) memory_only."""

    status: str
    docs: DataFrame
    truncated: bool
    skipped: int
    skip_reasons: list[str]


@dataclass
class ReadRef:
    id: str
    path: str
    hash: str
    title: str


class Engine:
    """Roots are folders that are mounted on all nodes; what is derived from one lies in its state folder."""

    def __init__(self, spark: SparkSession, config: configs.Config, spread_walk: bool = False):
        """``spread_walk``: folders are listed by the executors, for roots with millions of files."""
        self.spark, self.config = spark, config
        self.listing = files.spread_listing if spread_walk else files.listing
        self.refs: dict[str, ReadRef] = {}

    @staticmethod
    def _state(root: configs.Root, *parts: str) -> str:
        """A place in the root's state folder, on the file system that the root is mounted on."""
        return "file://" + os.path.join(root.path, STATE_FOLDER, *parts)

    def store(self, root: configs.Root) -> IndexStore:
        return IndexStore(self.spark, self._state(root, "index"), root.path)

    def _configured(self) -> tuple[DataFrame, DataFrame]:
        roots = self.spark.createDataFrame([(r.name, r.path, r.exclude) for r in self.config.roots], ownership.ROOTS)
        bindings = self.spark.createDataFrame([(b.root, b.path, (b.scope.kind, list(b.scope.projects))) for b in self.config.bindings], ownership.BINDINGS)
        return roots, bindings

    def refresh(self, name: str, budget: files.Budget | None = None) -> dict[str, int]:
        """Bring a root's index up to date; files are hashed only where size, time or titles changed.

        A truncated walk never deletes.  Derived notes are no part of the walk and stay until their source changes.
        """
        root, budget = self.config.root(name), budget or files.Budget()
        other = self.config.writable
        skip = files.skip_inside(root.path, other.path if other else None, root.writable)
        listed = self.listing(self.spark, name, root.path, budget, skip_inside=skip, exclude=root.exclude).persist()
        exports = listed.withColumns({"folder": F.regexp_replace("rel_path", "[^/]*$", ""), "file": F.regexp_extract("rel_path", "[^/]*$", 0)})
        metas = files.text_files(exports.filter(F.col("file").rlike(r"_(readme\.md|info\.json)$")))
        titles = notes.readme_titles(metas.filter(F.col("file").endswith("_readme.md")))
        catalogs = notes.info_titles(metas.filter(F.col("file").endswith("_info.json")))
        mapped = notes.with_export_titles(exports, titles, catalogs)
        mark = F.when(is_ai_note(F.col("rel_path")), F.lit("ai")).otherwise(F.sha2(F.concat_ws("\n", F.coalesce("mapped_title", F.lit("")), F.array_join("catalog", "/")), 256))
        now = mapped.withColumn("fingerprint", mark).persist()
        store = self.store(root)
        previous = store.docs().filter("kind <> 'derived'")
        status = files.changes(previous.select("rel_path", "size", "mtime_ms", "fingerprint", "source_hash"), now.select("rel_path", "size", "mtime_ms", "fingerprint")).persist()
        wanted = now.join(status.filter("status in ('insert', 'check')"), "rel_path", "left_semi")
        tried = files.read_texts(wanted)
        unchanged = previous.select("rel_path", "source_hash", "fingerprint")
        read = tried.join(unchanged, ["rel_path", "source_hash", "fingerprint"], "left_anti").persist()
        new = read.filter("reason is null")
        ai, meta = is_ai_note(F.col("rel_path")), notes.note_meta(F.col("text"))
        docs = new.select(
            doc_key(F.lit(root.path), F.col("rel_path")).alias("doc_id"), "rel_path", "path",
            F.when(ai, notes.note_kind(F.col("text"))).otherwise(F.lit("original")).alias("kind"),
            choose_title(F.col("mapped_title"), F.col("text"), F.col("rel_path")).alias("title"), "catalog", "source_hash",
            F.when(ai, meta["sourcePath"]).alias("source_path"), F.when(ai, meta["sourceHash"]).alias("source_file_hash"),
            F.when(ai, notes.parse_scope(meta["scope"])).alias("scope"), "mtime_ms", "size", "fingerprint", note_lines(F.col("text")).alias("lines"),
        ).persist()
        gone = status.filter("status = 'delete'").select(doc_key(F.lit(root.path), F.col("rel_path")).alias("doc_id")) if not budget.truncated else None
        made = store.commit(docs.drop("lines"), postings(docs.select("doc_id", "rel_path", "title", "catalog", "lines")), gone, complete=not budget.truncated)
        unread = read.filter("reason is not null").agg(F.count("*").alias("n"), F.collect_set("reason").alias("reasons")).first()  # few kinds of reasons
        report = Report()
        report.add(budget.truncated, budget.skipped + unread.n, [*budget.reasons, *sorted(unread.reasons)])
        store.folder.write(json.dumps(report.__dict__), "walk.json")
        counts = {"seen": listed.count(), "updated": docs.count(), "deleted": gone.count() if gone is not None else 0, "documents": made.doc_count, "generation": made.generation}
        for x in (listed, now, status, read, docs):
            x.unpersist()
        return counts

    def visible(self, docs: DataFrame, project_ids: list[str]) -> DataFrame:
        roots, bindings = self._configured()
        own = ownership.document_ownership(docs, roots, bindings)
        return own.filter(ownership.is_visible(F.col("own_excluded"), F.col("own_kind"), F.col("own_projects"), self.config.isolation, project_ids))

    def _reported(self, root: configs.Root, report: Report) -> None:
        """Add what the last walk of an indexed root left out."""
        g, text = self.store(root).generation(), self.store(root).folder.read("walk.json")
        walk = json.loads(text) if text else {}
        report.add(bool(walk.get("truncated")) or not (g and g.complete), walk.get("skipped", 0), walk.get("skip_reasons", []))

    def _shown(self, rows: DataFrame, root: configs.Root, wanted: list[str], preferred, score, semantic=None) -> DataFrame:
        """Rows of documents with text as hits."""
        lines = F.lit(None).cast("array<int>") if preferred is None else preferred
        return rows.select(
            F.lit(root.name).alias("root"), "kind", "path", "rel_path", "title", "catalog", "source_path", "scope", score.cast("double").alias("score"),
            (F.col("partial") if "partial" in rows.columns else F.lit(False)).alias("partial"), search.snippets(F.col("text"), wanted, lines).alias("snippets"),
            search.preview(F.col("text"), wanted[0] if wanted else "").alias("preview"), F.lit(semantic is not None).alias("semantic"), (F.lit(None).cast("string") if semantic is None else semantic).alias("evidence"),
        )

    def _indexed_hits(self, root: configs.Root, query: str, limit: int, project_ids: list[str], again: bool = True) -> DataFrame:
        store = self.store(root)
        generation = store.generation()
        pinned = generation.generation
        docs = store.docs(pinned)
        scoped = self.visible(docs, project_ids).select("doc_id") if self.config.isolation else None
        groups, phrases = parse_query(query)
        wanted = [t for g in groups + phrases for t in needles(g)]
        top = search.best(search.rank(store.get_postings(wanted, pinned), query, scoped, generation.doc_count, phrase_terms=not groups), max(4 * limit, 20))
        found = docs.join(F.broadcast(top), "doc_id").orderBy(F.desc("groups"), F.desc("score"), "doc_id").limit(3 * limit).persist()
        live = files.text_files(found.select("path").unionByName(found.filter("source_path is not null").select(F.col("source_path").alias("path"))).distinct())
        live = live.withColumn("content", F.encode("text", "UTF-8")).persist()
        fresh = search.fresh(found, live.select("path", "content")).join(live.select("path", "text"), "path")
        fresh = search.has_phrases(fresh, phrases) if phrases else fresh
        hits = self._shown(fresh, root, wanted, F.col("lines"), F.col("score"))
        if again and hits.isEmpty() and not found.isEmpty():
            self.refresh(root.name)
            return self._indexed_hits(root, query, limit, project_ids, again=False)
        return hits

    def _allowed(self, docs: DataFrame, project_ids: list[str]) -> DataFrame:
        return self.visible(docs, project_ids).select(docs.columns) if self.config.isolation else docs

    def _note_hits(self, root: configs.Root, query: str, project_ids: list[str], report: Report) -> DataFrame:
        """A scan of the notes of a writable root; digests whose source has changed or can't be read are skipped."""
        budget = self.scan_budget()
        listed = self.listing(self.spark, root.name, root.path, budget, skip_inside=[os.path.join(root.path, STATE_FOLDER)], exclude=root.exclude)
        texts = files.text_files(listed.filter(is_ai_note(F.col("rel_path")))).persist()
        meta = notes.note_meta(F.col("text"))
        sources = files.text_files(texts.select(meta["sourcePath"].alias("path")).filter("path is not null").distinct())
        inside = F.lit(False)
        for r in self.config.roots:
            inside = inside | F.col("path").startswith(r.path + "/")
        judged = notes.digest_status(texts.select("path", "rel_path", "text"), sources.select("path", F.col("source_hash").alias("hash"), inside.alias("in_scope")))
        judged = judged.withColumns({"kind": notes.note_kind(F.col("text")), "source_path": meta["sourcePath"], "scope": notes.parse_scope(meta["scope"]), "_extra": F.concat_ws("\n", meta["sourceTitle"], meta["sourcePath"])}).persist()
        stale = (F.col("kind") == "digest") & (F.col("status") != "unchanged")
        gone = judged.filter(stale).agg(F.count("*").alias("n"), F.collect_set("status").alias("kinds")).first()
        report.add(budget.truncated, budget.skipped + gone.n, [*budget.reasons, *(f"stale-digest:{k}" for k in sorted(gone.kinds))])
        usable = self._allowed(judged.filter(~stale), project_ids)
        found = search.scan(usable, query, F.col("_extra")).withColumns({"title": F.lit(None).cast("string"), "catalog": F.array().cast("array<string>")})
        return self._shown(found, root, query_terms(query), None, F.col("path_score"))

    @staticmethod
    def scan_budget() -> files.Budget:
        """What a search may read of a root that has no index."""
        return files.Budget(seconds=5, entries=10_000, bytes=32 << 20)

    def _scanned_hits(self, root: configs.Root, query: str, project_ids: list[str], report: Report) -> DataFrame:
        """A scan of the root's documents, for roots without an index; records of current documents help to find them."""
        prepared = self.prepare(root.name, budget=self.scan_budget())
        report.add(prepared.truncated, prepared.skipped, prepared.skip_reasons)
        none = F.lit(None).cast("string")
        docs = prepared.docs.withColumns({"text": F.array_join("lines", "\n"), "kind": F.lit("original"), "source_path": none, "scope": F.lit(None).cast(notes.SCOPE), "_title": F.concat_ws("\n", "title", F.array_join("catalog", " / "))})
        docs = self._allowed(docs, project_ids)
        records, terms = self.records(root), query_terms(query)
        if records is None:
            return self._shown(search.scan(docs, query, F.col("_title")), root, terms, None, F.col("path_score"))
        fields = [F.col(c) for c in ("topics", "aliases", "questions", "rules")]
        usable = records.select("path", "source_hash", search.semantic_extra(*fields).alias("_semantic"), search.semantic_evidence([t.lower() for t in terms]).alias("evidence"))
        known = docs.join(usable, ["path", "source_hash"], "left")
        base = search.scan(known, query, F.col("_title"))
        rest = search.scan(known.filter("_semantic is not null"), query, F.concat_ws("\n", "_title", "_semantic")).join(base.select("path"), "path", "left_anti")
        score = F.col("path_score") + F.col("_semantic").isNotNull().cast("int")
        return self._shown(base, root, terms, None, score).unionByName(self._shown(rest, root, terms, None, score, F.col("evidence")))

    def records(self, root: configs.Root) -> DataFrame | None:
        """Records of a root's documents that the last enrichment made."""
        folder = Folder(self.spark, self._state(root, "records"))
        try:
            return self.spark.read.parquet(folder.path(json.loads(folder.read("current.json") or "")["table"]))
        except (ValueError, KeyError):
            return None

    def _semantic_hits(self, root: configs.Root, query: str, project_ids: list[str]) -> DataFrame | None:
        """Hits by records; only the files of records that match are read."""
        records = self.records(root)
        if records is None:
            return None
        matches = search.semantic_matches(records, query)
        live = files.text_files(matches.select("path").distinct()).select("path", "source_hash")
        found = matches.join(live, ["path", "source_hash"], "left_semi").withColumns({"kind": F.lit("original"), "source_path": F.lit(None).cast("string"), "scope": F.lit(None).cast(notes.SCOPE)})
        found = self._allowed(found, project_ids)
        return found.select(
            F.lit(root.name).alias("root"), "kind", "path", "rel_path", "title", F.array().cast("array<string>").alias("catalog"), "source_path", "scope", "score", F.lit(False).alias("partial"),
            F.array().cast("array<struct<line:int,text:string>>").alias("snippets"), F.lit("").alias("preview"), F.lit(True).alias("semantic"), "evidence",
        )

    def _root_hits(self, root: configs.Root, query: str, limit: int, project_ids: list[str], report: Report, index: bool) -> list[DataFrame]:
        """By the index (built first if there is none), else by scans; by records in either case."""
        if index and self.store(root).generation() is None:
            try:
                self.refresh(root.name)
            except (IndexBusy, OSError, PySparkException, Py4JError):  # another writer's turn, or a folder that can't be written to
                index = False
        if index:
            parts = [self._indexed_hits(root, query, limit, project_ids)]
            self._reported(root, report)
        else:
            parts = [self._note_hits(root, query, project_ids, report)] if root.writable else []
            parts.append(self._scanned_hits(root, query, project_ids, report))
        semantic = self._semantic_hits(root, query, project_ids)
        return parts if semantic is None else [*parts, semantic]

    def search(self, query: str, root: str | None = None, limit: int | None = None, project_ids: list[str] | None = None, index: bool = True) -> Result:
        """The best hits of one root or of all that exist, one for each source; without ``index`` by scans alone."""
        if not self.config.enabled:
            raise configs.ConfigError("search is switched off")
        query_terms(query)
        limit, report = search.clamp_limit(limit), Report()
        roots = [self.config.root(root)] if root else [r for r in self.config.roots if r.exists]
        if root and not roots[0].exists and not roots[0].writable:
            raise configs.ConfigError(f"the folder of root {root} doesn't exist")
        parts = [part for r in roots if r.exists for part in self._root_hits(r, query, limit, project_ids or [], report, index)]
        if not parts:
            return Result(self.spark.createDataFrame([], HITS))
        hits = search.unite(parts).persist()
        merged = search.merge_hits(hits).select("source_key", "kind", "path", "score", "partial", F.col("title").alias("_title"))
        means = hits.filter("semantic").groupBy(F.coalesce("source_path", "path").alias("source_key")).agg(F.lit(True).alias("semantic"), F.min("evidence").alias("evidence"))
        # The richest of a path's hits gives what is shown of it.
        shown = hits.groupBy("path").agg(F.max_by(F.struct(*(c for c in hits.columns if c not in ("path", "kind", "score", "partial", "title", "semantic", "evidence"))), F.struct(F.size("snippets"), ~F.col("semantic"))).alias("_s"))
        out = merged.join(shown, "path").join(means, "source_key", "left").select("path", "kind", "score", "partial", F.col("_title").alias("title"), "_s.*", F.coalesce("semantic", F.lit(False)).alias("semantic"), "evidence")
        return Result(search.order_hits(out, limit), report.truncated, report.skipped, report.skip_reasons)

    def record_read(self, path: str, whole: bool = True, answer: str = "", offset: int | None = None) -> ReadRef | None:
        """A reference to a source that was read in full; its hash proves later that it hasn't changed.

        ``answer`` and ``offset`` are the reading tool's: one that began late or says that more follows is no full reading.
        """
        real = os.path.realpath(path)
        whole = whole and (not answer and offset is None or not self._column(answer, lambda t: is_truncated_read(t, F.lit(offset))))
        if not whole or not any(files.inside(real, r.path) and not files.is_excluded(os.path.relpath(real, r.path), r.exclude) for r in self.config.roots):
            return None
        with open(real, "rb") as f:
            data = f.read()
        ref = ReadRef(str(uuid.uuid4()), real, hashlib.sha256(data).hexdigest(), os.path.splitext(os.path.basename(real))[0])
        self.refs[ref.id] = self.refs[real] = ref
        return ref

    def _column(self, value: str, f):
        return self.spark.range(1).select(f(F.lit(value)).alias("x")).first().x

    def write_note(self, title: str, body: str, read_ref: str | None = None, cwd: str = "", scope: configs.Scope | None = None, author: str = "user") -> str:
        """A digest of a source that was read, or else a lesson; the path of the new (or equal, existing) file."""
        root = self.config.writable
        if root is None:
            raise configs.ConfigError("no root is writable")
        title, body = title.strip(), body.strip()
        if not title or len(title) > TITLE_MAX or "\n" in title or not body or len(body.encode()) > BODY_MAX:
            raise ValueError("a title needs 1 to 120 characters in one line, a body 1 byte to 16 KiB")
        if kind := self._column(f"{title}\n{body}", secret_kind):
            raise ValueError(f"the note holds a secret ({kind})")
        now = datetime.datetime.now(datetime.timezone.utc)
        meta = {"createdAt": now.isoformat(), "author": author, "cwd": cwd}
        if read_ref is None:
            folder, name = "lessons", f"{now:%Y-%m-%d}-{uuid.uuid4()}.md"
            meta = {"type": "lesson", **meta} | ({"scope": scope.to_json()} if scope else {})
        else:
            ref = self.refs.get(self._column(read_ref, read_reference)) or self.refs.get(os.path.realpath(read_ref))
            if ref is None:
                raise ValueError("the reference isn't known")
            with open(ref.path, "rb") as f:
                if hashlib.sha256(f.read()).hexdigest() != ref.hash:
                    raise ValueError("the source has changed since it was read")
            folder, name = "digests", f"{hashlib.sha256(ref.path.encode()).hexdigest()}-{ref.hash}.md"
            meta = {"type": "digest", **meta, "sourcePath": ref.path, "sourceHash": ref.hash, "sourceTitle": ref.title, "coverage": "full-text"}
        path = os.path.join(root.path, folder, name)
        self._publish(path, notes.format_note(meta, title, body))
        self.refresh(root.name)
        return path

    @staticmethod
    def _publish(path: str, text: str) -> None:
        """Write aside, then link: an existing file is never overwritten."""
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temp = os.path.join(os.path.dirname(path), f".tmp-{uuid.uuid4().hex}")
        with open(temp, "x", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(temp, path)
        except FileExistsError:
            pass
        finally:
            os.unlink(temp)

    def prepare(self, name: str, state: str | None = None, budget: files.Budget | None = None) -> Prepared:
        """A snapshot of a root's documents with their lines.  A truncated walk is never written, and says so."""
        root, budget = self.config.root(name), budget or files.Budget()
        other = self.config.writable
        listed = self.listing(self.spark, name, root.path, budget, skip_inside=files.skip_inside(root.path, other.path if other else None, root.writable, prepare=True), exclude=root.exclude)
        read = files.read_texts(listed)
        title = choose_title(F.lit(None).cast("string"), F.col("text"), F.col("rel_path")).alias("title")
        docs = read.filter("reason is null").select("path", "rel_path", "source_hash", title, F.array().cast("array<string>").alias("catalog"), note_lines(F.col("text")).alias("lines"))
        row = F.xxhash64("path", "source_hash")  # sums and parities don't depend on an order, so no task has to hold all rows
        good = F.col("reason").isNull()
        seen = read.agg(F.count_if(good).alias("n"), F.sum(F.when(good, row).cast("decimal(38,0)")).alias("total"), F.bit_xor(F.when(good, row)).alias("parity"), F.count_if(~good).alias("skipped"), F.collect_set("reason").alias("reasons")).first()
        report = Report()
        report.add(budget.truncated, budget.skipped + seen.skipped, [*budget.reasons, *sorted(seen.reasons)])
        told = (report.truncated, report.skipped, report.skip_reasons)
        folder = Folder(self.spark, state or self._state(root, "snapshot"))
        try:
            old = json.loads(folder.read("snapshot.json") or "")
            old = old if old.get("version") == SNAPSHOT_VERSION else None
        except ValueError:
            old = None
        print_ = f"{seen.n}:{seen.total}:{seen.parity}:{root.path}:{root.exclude}"
        if budget.truncated:
            return Prepared("memory_only", docs, *told)
        if old and old["fingerprint"] == print_:
            return Prepared("reused", self.spark.read.schema(docs.schema).parquet(folder.path(old["table"])), old["truncated"], old["skipped"], old["skip_reasons"])
        table = f"docs-{uuid.uuid4().hex}"
        try:
            docs.write.parquet(folder.path(table))
            folder.write(json.dumps({"version": SNAPSHOT_VERSION, "fingerprint": print_, "table": table, **report.__dict__}), "snapshot.json")
        except (OSError, PySparkException, Py4JError):  # a root that can't be written to
            return Prepared("memory_only", docs, *told)
        if old:
            folder.delete(old["table"])
        return Prepared("updated" if old else "created", self.spark.read.schema(docs.schema).parquet(folder.path(table)), *told)

    def enrich(self, name: str, complete: chunks.Complete, budget: files.Budget | None = None, partial: bool = False, full: bool = False, **options) -> DataFrame:
        """Records of a root's documents, from a resumable job; derived notes are indexed with their aliases.

        Concurrency and retries are those of the configuration unless given.  A truncated snapshot is refused
        unless ``partial`` allows it.  ``full`` asks again for what is completed.
        """
        root = self.config.root(name)
        prepared = self.prepare(name, budget=budget)
        if prepared.truncated and not partial:
            raise ValueError(f"the walk of {name} was cut short ({', '.join(prepared.skip_reasons)}): give a larger budget, or allow a partial run")
        docs = prepared.docs
        settings = {k: self.config.enrich[k] for k in ("concurrency", "retries")} if self.config.enrich else {}
        cut = chunks.chunks(docs.select("path", "rel_path", "source_hash", "lines"), "path")
        parts = chunks.with_text(cut, docs.select("path", "lines"), "path")
        key = ["path", "source_hash", "idx", "start_line", "end_line"]
        done = chunks.Job(self._state(root, "job"), complete, full=full, **(settings | options)).run(parts, key)
        records = chunks.merge_outputs(done, docs.select("path", "source_hash"), "path").join(docs.select("path", "rel_path", "title"), "path")
        body = chunks.derived_body(F.col("summary"), F.col("rules"), F.col("aliases"), F.col("questions"))
        rel = F.concat(F.lit(f"{STATE_FOLDER}/notes/"), doc_key(F.lit(root.path), F.col("rel_path")), F.lit(".md"))
        made = self._written(root, records.withColumns({"note": rel, "body": body}))
        docs_new = made.select(
            doc_key(F.lit(root.path), F.col("note")).alias("doc_id"), F.col("note").alias("rel_path"), F.col("note_path").alias("path"), F.lit("derived").alias("kind"), "title",
            F.array().cast("array<string>").alias("catalog"), F.col("note_hash").alias("source_hash"), F.col("path").alias("source_path"), F.col("source_hash").alias("source_file_hash"),
            F.lit(None).cast("struct<kind:string,projects:array<string>>").alias("scope"), F.lit(0.0).alias("mtime_ms"), F.lit(0).cast("long").alias("size"), F.lit("derived").alias("fingerprint"),
            F.split("body", "\n").alias("lines"), F.array_join(F.concat("topics", "aliases", "questions"), "\n").alias("extra"),
        )
        store = self.store(root)
        current = store.generation()
        store.commit(docs_new.select(*[c.split()[0] for c in DOCS.split(", ")]), postings(docs_new.select("doc_id", "rel_path", "title", "catalog", "lines", "extra")), complete=bool(current and current.complete))
        return made

    def _written(self, root: configs.Root, records: DataFrame) -> DataFrame:
        """Records with the path and hash of their notes; the executors write the notes into the mounted root, and the table is kept."""
        importable(self.spark)
        base = root.path

        def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                paths, hashes = [], []
                for r in batch.itertuples():
                    path = os.path.join(base, r.note)
                    text = notes.format_note({"type": "derived", "createdAt": "", "author": notes.TAG, "cwd": base, "sourcePath": r.path, "sourceHash": r.source_hash, "sourceTitle": r.title, "coverage": "derived"}, r.title, r.body)
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    temp = f"{path}.{uuid.uuid4().hex}.tmp"
                    with open(temp, "w", encoding="utf-8") as f:
                        f.write(text)
                    os.replace(temp, path)
                    paths.append(path)
                    hashes.append(hashlib.sha256(text.encode()).hexdigest())
                yield batch[["path", "note"]].assign(note_path=paths, note_hash=hashes)

        folder = Folder(self.spark, self._state(root, "records"))
        table = f"records-{uuid.uuid4().hex}"
        records.write.parquet(folder.path(f"{table}-made"))
        kept = self.spark.read.schema(records.schema).parquet(folder.path(f"{table}-made"))
        notes_ = kept.select("path", "source_hash", "title", "note", "body").mapInPandas(write, "path string, note string, note_path string, note_hash string")
        kept.join(notes_.drop("note"), "path").write.parquet(folder.path(table))
        folder.write(json.dumps({"table": table}), "current.json")
        for name in folder.names():
            if name.startswith("records-") and name != table:
                folder.delete(name)
        return self.spark.read.parquet(folder.path(table))

    def job_state(self, name: str) -> DataFrame | None:
        """Counts of the last enrichment's results: total, done, failed, pending, percent and state."""
        job = chunks.Job(self._state(self.config.root(name), "job"), None)
        results = job.results(self.spark)
        if results is None:
            return None
        key = ["path", "source_hash", "idx", "start_line", "end_line"]
        latest = results.groupBy(*key).agg(F.max_by("status", F.col("status") == "completed").alias("status"))
        return chunks.job_summary(latest.withColumn("root", F.lit(name)))

    def visible_roots(self, project_ids: list[str] = (), include_shared: bool = False) -> int:
        return configs.visible_roots(self.config, project_ids, include_shared)

    def status(self) -> list[dict]:
        """A row for each root: where it is, what may be written, and the state of its index and of its last enrichment."""
        out = []
        for r in self.config.roots:
            g = self.store(r).generation() if r.exists else None
            job = self.job_state(r.name) if r.exists else None
            index = "none" if g is None else "ready" if g.complete else "building"
            out.append({
                "root": r.name, "path": r.path, "exists": r.exists, "writable": r.writable, "exclude": r.exclude, "documents": g.doc_count if g else 0, "generation": g.generation if g else None,
                "complete": bool(g and g.complete), "index": index, "job": job.first().asDict() if job is not None else None,
                "model": f"{self.config.enrich['provider']}/{self.config.enrich['model']}" if self.config.enrich else None, "isolation": self.config.isolation, "enabled": self.config.enabled,
            })
        return out
