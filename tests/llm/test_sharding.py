import zlib
from collections import Counter, defaultdict

import numpy as np

from loomdex.llm import sharding

from .texts import SCHEMA, frame


def check(rows, n):
    assert len(rows) == n
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    counts = [len(slots.get(s, [])) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == n


def test_rows_are_balanced_and_slots_gapless(spark):
    df = frame(spark)
    rows = sharding.shard_documents(df).collect()
    check(rows, df.count())
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_hot_key_overflows_clockwise(spark):
    hot = spark.range(300).selectExpr("7L AS doc_id", "'same' AS text").unionByName(spark.range(100).selectExpr("id AS doc_id", "'x' AS text"))
    check(sharding.shard_documents(hot).collect(), 400)


def test_most_rows_stay_with_the_ring_and_few_move(spark):
    narrow = spark.range(8000).withColumnRenamed("id", "doc_id")
    a, b = sharding.shard_rows(narrow, "doc_id", 16), sharding.shard_rows(narrow, "doc_id", 17)
    r = sharding.moved(a, b).first()
    assert r.rows == 8000 and r.moved < 8000 * 0.1  # 1 in 17 has to


def test_resolve_is_the_walk_over_single_keys():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n, shards = int(rng.integers(1, 30)), int(rng.integers(1, 6))
        arcs, owner = rng.integers(0, 9, n), rng.integers(0, shards, n).astype(np.int32)
        owner[: min(n, shards)] = np.arange(min(n, shards))
        if n < shards:
            continue
        room = sharding.quotas(int(arcs.sum()), shards)
        out = sharding.resolve(arcs, owner, room)
        assert [sum(c for _, c in x) for x in out] == arcs.tolist()
        used = Counter()
        for x in out:
            for s, c in x:
                used[s] += c
        assert all(used[s] == room[s] for s in range(shards))
        for a, x in enumerate(out):
            home = sum(c for s, c in x if s == owner[a])
            assert home == arcs[a] or used[owner[a]] == room[owner[a]]


def walk(arcs, owner, room):
    """Each key on its own: to its shard while that has room, else clockwise to the first point whose shard has."""
    room, placed, over = room.copy(), [[] for _ in arcs], []
    for a, count in enumerate(arcs):
        for _ in range(int(count)):
            if room[owner[a]]:
                room[owner[a]] -= 1
                placed[a].append(int(owner[a]))
            else:
                over.append(a)
    for a in over:
        s = next(int(owner[(a + k) % len(arcs)]) for k in range(len(arcs)) if room[owner[(a + k) % len(arcs)]])
        room[s] -= 1
        placed[a].append(s)
    return placed


def test_resolve_places_each_key_where_the_walk_does():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n, shards = int(rng.integers(3, 40)), int(rng.integers(1, 4))
        arcs, owner = rng.integers(0, 12, n) * rng.integers(0, 2, n), rng.integers(0, shards, n).astype(np.int32)
        owner[:shards] = np.arange(shards)
        if rng.random() < 0.5:
            arcs[rng.integers(0, n)] = 200  # a hot arc
        room = sharding.quotas(int(arcs.sum()), shards)
        out = sharding.resolve(arcs, owner, room)
        assert [[s for s, count in parts for _ in range(count)] for parts in out] == walk(arcs, owner, room)


def test_other_columns_stay_whatever_their_names(spark):
    own = ["_row", "_part", "_place", "_at", "_arc", "data", "shard", "odd `name.x"]
    df = spark.createDataFrame([(i, *[f"{c}{i}" for c in own]) for i in range(40)], ["key", *own])
    out = sharding.shard_rows(df, "key")
    assert out.columns == ["key", *[c for c in own if c != "shard"], "shard", "slot"]
    assert {(r["key"], r["_arc"], r["odd `name.x"]) for r in out.collect()} == {(i, f"_arc{i}", f"odd `name.x{i}") for i in range(40)}
