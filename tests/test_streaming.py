import json
import os

from pyspark.sql import functions as F

from loomdex.functions.text import doc_key
from loomdex.sources.index_store import DOCS, IndexStore
from loomdex.streaming import indexer


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


def as_docs(stream):
    none = F.lit(None).cast("string")
    return stream.select(
        doc_key(F.lit("s"), F.col("path")).alias("doc_id"), F.col("path").alias("rel_path"), "path", F.lit("original").alias("kind"), F.lit("t").alias("title"), F.array().cast("array<string>").alias("catalog"),
        F.sha2("text", 256).alias("source_hash"), none.alias("source_path"), none.alias("source_file_hash"), F.lit(None).cast("struct<kind:string,projects:array<string>>").alias("scope"),
        F.col("v").cast("double").alias("mtime_ms"), F.length("text").cast("long").alias("size"), F.lit("").alias("fingerprint"), F.split("text", "\n").alias("lines"),
    )


def test_an_index_follows_a_stream_and_survives_a_restart(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), "s", per_bucket=1)
    source = f"{tmp_path}/in"
    put(source, "1.json", [{"path": "a", "v": 1, "text": "old words"}, {"path": "a", "v": 2, "text": "new words"}, {"path": "b", "v": 1, "text": "words"}])
    stream = lambda: as_docs(spark.readStream.schema("path string, v int, text string").json(source))
    seen = []
    indexer.follow(stream(), store, f"{tmp_path}/check", lambda n, docs: seen.append((n, docs))).awaitTermination(120)
    assert store.docs().count() == 2 and store.get_postings(["old"]).count() == 0 and not store.generation().complete
    put(source, "2.json", [{"path": "b", "v": 2, "text": "later"}])
    indexer.follow(stream(), store, f"{tmp_path}/check", lambda n, docs: seen.append((n, docs))).awaitTermination(120)
    assert store.get_postings(["words"]).count() == 1 and store.get_postings(["later"]).count() == 1 and seen == [(0, 2), (1, 2)]
    indexer.finish(store)
    assert store.generation().complete and [c.split()[0] for c in DOCS.split(", ")][0] == "doc_id"


def test_stream_postings(spark, tmp_path):
    put(f"{tmp_path}/in", "1.json", [{"doc_id": 1, "text": "alphaBeta\nx"}])
    out = indexer.stream_postings(spark.readStream.schema("doc_id long, text string").json(f"{tmp_path}/in"))
    q = out.writeStream.format("memory").queryName("terms").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.line, r.term) for r in spark.table("terms").collect()) == [(1, "alpha"), (1, "alphabeta"), (1, "beta"), (2, "x")]


def test_reads_are_matched_across_batches(spark, tmp_path):
    source = f"{tmp_path}/in"
    put(source, "1.json", [{"call_id": "x", "event": "call", "path": "/p", "hash": "1"}, {"call_id": "y", "event": "call", "path": "/q", "hash": "1"}])
    events = lambda: spark.readStream.schema("call_id string, event string, path string, hash string").option("maxFilesPerTrigger", 1).json(source)
    run = lambda: indexer.match_reads(events()).writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(120)
    run()
    put(source, "2.json", [{"call_id": "x", "event": "result", "path": "/p", "hash": "1"}, {"call_id": "y", "event": "result", "path": "/q", "hash": "2"}])
    run()
    assert {(r.call_id, r.matched) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("x", True), ("y", False)}
