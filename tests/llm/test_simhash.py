import random
import re
from collections import Counter

import xxhash

from loomdex.llm import simhash

from .texts import SCHEMA, frame


def brute_fingerprint(text):
    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return Counter((i, f"{fp:016x}", least.get(root(k))) for k, (i, fp) in enumerate(fps))


def test_matches_brute_force(spark):
    random.seed(5)
    base = [f"w{random.randrange(500)}" for _ in range(120)]
    more = []
    for k in range(60):
        words = base[:]
        for _ in range(random.randrange(3)):
            words[random.randrange(120)] = f"x{k}"
        more.append((2000 + k, " ".join(words)))
    df = frame(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()] + more
    both = df.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(both).collect())
    assert got == brute_components(rows)


def test_large_shards_are_split_and_lose_no_link(spark):
    random.seed(7)
    centre, other = random.getrandbits(64), random.getrandbits(64)
    values = {centre, other}
    for _ in range(300):
        x = centre
        for _ in range(random.randrange(1, 7)):
            x ^= 1 << random.randrange(64)
        values.add(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.fingerprint_links(nodes, shard=16)).collect()}
    left, classes = set(values), []
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            x = todo.pop()
            seen.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 4}
            left -= near
            todo += near
        classes.append(seen)
    for c in classes:
        c = {v - (1 << 64) if v >> 63 else v for v in c}
        assert {found.get(v, v) for v in c} == {min(c)}


def test_tables_cover_every_pair():
    random.seed(3)
    for nodes in (0, 10_000, 10**7, 10**9, 10**12):
        tables = simhash.tables_for(nodes)
        for _ in range(300):
            x = 0
            for b in random.sample(range(64), 4):
                x ^= 1 << b
            assert any(all(x >> s & ((1 << n) - 1) == 0 for s, n in ranges) for ranges in tables)


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_edges_are_pairs_within_the_radius_and_make_the_same_classes():
    random.seed(9)
    centre = random.getrandbits(64)
    values = sorted({centre ^ sum(1 << b for b in random.sample(range(64), random.randrange(8))) for _ in range(150)})
    for left, right in ((values, None), (values[:70], values[70:])):
        made = simhash.links(left, right, edges=True)
        assert all((a ^ b).bit_count() <= simhash.RADIUS for a, b in made)
        assert len(made) == len(simhash.links(left, right)) > 10


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
