"""Streaming forms: postings of arriving documents, an index that follows them, and matching of reads."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.postings import postings
from ..sources.index_store import IndexBusy, IndexStore


def stream_postings(docs: DataFrame) -> DataFrame:
    """Terms of a stream of documents, a row for each emission group of a line; needs no state."""
    from ..functions.text import as_lines
    from ..functions.tokens import terms

    line = docs.select("doc_id", F.posexplode(as_lines(F.col("text"))).alias("n", "line"))
    return line.select("doc_id", (F.col("n") + 1).alias("line"), F.explode(terms(F.col("line"))).alias("term"))


def follow(docs: DataFrame, store: IndexStore, checkpoint: str, on_progress: Callable[[int, int], None] | None = None, **trigger) -> StreamingQuery:
    """Commit each micro-batch of documents (DOCS and lines) to the index.

    A batch that is replayed after a failure replaces its own documents, so it changes nothing.  Commits are
    incomplete until ``finish``: only a full walk knows what was deleted.
    """

    def commit(batch: DataFrame, number: int) -> None:
        # The newest of several versions of a document within the batch.
        latest = batch.groupBy("doc_id").agg(F.max_by(F.struct(*batch.columns), "mtime_ms").alias("r")).select("r.*").persist()
        made = store.commit(latest.drop("lines"), postings(latest.select("doc_id", "rel_path", "title", "catalog", "lines")), complete=False)
        latest.unpersist()
        if on_progress:
            on_progress(number, made.doc_count)

    return docs.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def finish(store: IndexStore) -> None:
    store.commit(None, None, complete=True)


def poll(refresh: Callable[[str], dict], roots: Callable[[], list[str]], seconds: float = 60.0, stop: Callable[[], bool] = lambda: False, on_progress: Callable[[str, dict], None] | None = None) -> int:
    """Walk the roots again and again, so that edits and deletions are seen as well as new files; the number of rounds.

    ``roots`` is asked anew in each round, so a changed configuration takes effect.  A root that fails is left to the
    next round.  ``stop`` is asked between roots and while waiting.
    """
    rounds = 0
    while not stop():
        began = time.monotonic()
        for name in roots():
            if stop():
                return rounds
            try:
                counts = refresh(name)
            except (IndexBusy, OSError, PySparkException) as e:
                counts = {"error": str(e)}
            if on_progress:
                on_progress(name, counts)
        rounds += 1
        while not stop() and time.monotonic() - began < seconds:
            time.sleep(min(0.2, seconds))
    return rounds


READS = "call_id string, path string, hash string, matched boolean"


def _match(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Keep a call's hash until its result comes; give a row when both are there."""
    held = state.get if state.exists else (None, None, None)
    call, result, path = held
    for frame in frames:
        for r in frame.itertuples():
            path = r.path
            if r.event == "call":
                call = r.hash
            else:
                result = r.hash
    if state.hasTimedOut:
        state.remove()
        return
    if call is not None and result is not None:
        if state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], path, result, call == result)], columns=["call_id", "path", "hash", "matched"])
    else:
        state.update((call, result, path))
        state.setTimeoutDuration(600_000)


def match_reads(events: DataFrame) -> DataFrame:
    """A row for each call (call_id, event: call or result, path, hash) whose result has come, and whether the file stayed the same."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.groupBy("call_id").applyInPandasWithState(_match, READS, "call string, result string, path string", "append", GroupStateTimeout.ProcessingTimeTimeout)
