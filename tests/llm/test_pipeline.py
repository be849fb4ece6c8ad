"""Each stage of the pipeline against a brute-force version of it, and the whole on edge rows."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from loomdex.llm import quality_classifier as qc
from loomdex.llm import quality_rules as qr

from .test_quality_rules import brute
from .test_near_copies import brute_classes
from .texts import SCHEMA, frame

SF = "/root/testdata/sf0.001"


def row(r):
    return tuple(r)


def bins(text):
    n, chars, symbols, dups, repeats, _ = brute(text)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    share = lambda a, b, by=1000: min(1000, by * a // max(b, 1))
    return [share(symbols, chars), share((text or "").count("!"), chars), share(repeats, n), share(dups, len(lines)), share(chars, n, 40)]


def brute_fences(own):
    """Low and high of each rule, by sorting the bins of a group's documents."""
    out = []
    for k, (bottom, top) in enumerate(qr.RULES.values()):
        values = sorted(b[k] for b in own)
        at = lambda p: values[-(-len(values) * p // 100) - 1]
        low = at(bottom) - max(2 * (at(50) - at(bottom)), 2) if bottom else -1
        out.append((low, at(top) + max(2 * (at(top) - at(50)), 2)))
    return out


def brute_rules(rows):
    """Rows that the rules keep: percentiles by sorting each group."""
    groups = defaultdict(list)
    for r in rows:
        if not brute(r.text)[5]:
            for key in ((r.lang, r.source), (r.lang,), ()):
                groups[key].append(bins(r.text))
    kept = []
    for r in rows:
        key = next((k for k in ((r.lang, r.source), (r.lang,), ()) if len(groups[k]) >= qr.LEAST), ())
        if not brute(r.text)[5] and all(low <= b <= high for b, (low, high) in zip(bins(r.text), brute_fences(groups[key]), strict=True)):
            kept.append(r)
    return kept


@pytest.mark.parametrize("edge", [False, True])
def test_stages_match_brute_force(spark, edge):
    docs = frame(spark) if edge else spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "quality_rules", "simhash_dedup", "best_fit_packing"]
    rows = docs.collect()

    first = stages["quality_classifier"](spark, docs, SF)
    forest = qc.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert Counter(map(row, first.collect())) == Counter(row(r) for r in rows if forest.score(qc.statistics_of([r.text]))[0] >= 0.3)

    second = stages["quality_rules"](spark, docs, SF)
    assert Counter(map(row, second.collect())) == Counter(map(row, brute_rules(rows)))

    third = stages["simhash_dedup"](spark, docs, SF)
    got = third.collect()
    ordered = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert Counter(r.doc_id for r in got) == Counter(ordered[k].doc_id for k in set(brute_classes([r.text for r in ordered])))
    assert not Counter(map(row, got)) - Counter(map(row, rows))
    for out in (first, second, third):
        assert out.schema == docs.schema

    last = stages["best_fit_packing"](spark, docs, SF)
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(last.columns)
    ends = defaultdict(int)
    for r in sorted(last.collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert ends[r.sequence_id] == r.offset
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048 and last.filter("piece = 0").count() == len(rows)


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda df: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(docs) == key(corpus_pipeline.run(spark, SF))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_runs_leave_their_stages_tables_only(spark):
    """What a stage writes on its way goes once its result is written; the last stage's tables are read by the result."""
    from loomdex.llm import common

    mark = common.made()
    out = corpus_pipeline.run(spark, SF)
    names = [path.rsplit("/", 1)[1] for path, _ in common._made.tables[mark:]]
    assert names == ["quality_classifier", "quality_rules", "simhash_dedup", "packing-pieces", "packing-ranked"] and out.count() > 0
    common.forget(mark)
    assert common.made() == mark
