import random
from collections import Counter

import corpus_pipeline
import numpy as np

from loomdex.llm import near_copies

from .texts import SCHEMA, frame


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_classes(texts):
    """The first member of each row's class, all pairs compared."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


def some_texts():
    random.seed(11)
    word = lambda: f"w{random.randrange(3000)}"
    line = " ".join(word() for _ in range(12))
    out = []
    for _ in range(12):
        base = [word() for _ in range(random.choice((6, 20, 80, 200)))]
        out += [" ".join([*base, line])] * 2
        for k in range(14):
            more = base[:]
            for _ in range(k % 5):
                more[random.randrange(len(more))] = word()
            out.append(" ".join([*more, line] if k % 3 else [line, *more[: -k or None]]))
    random.shuffle(out)
    return out


def test_stage_matches_brute_force_similarity(spark):
    """Near copies that differ in many bits of a 64-bit fingerprint are dropped too."""
    texts = some_texts()
    classes = brute_classes(texts)
    rows = [(i, t, "en", "s", len(t), *["x"] * 8) for i, t in enumerate(texts)]
    got = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, frame(spark, rows), None)
    assert got.schema == SCHEMA
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(classes))
    assert len(set(classes)) < len(set(texts))


def test_given_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    want = {rows[k].doc_id for k in brute_classes([r.text for r in rows])}
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == want


def test_frequent_shingles_change_no_result(spark, monkeypatch):
    texts = some_texts()
    docs = frame(spark, [(i, t, "en", "s", len(t), *["x"] * 8) for i, t in enumerate(texts)])
    assert len(near_copies.frequent_shingles(docs.select("text"))[0])
    monkeypatch.setattr(near_copies, "FREQUENT", 0)
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == set(brute_classes(texts))


def test_groups_of_several_classes_are_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CHUNK", 3)
    monkeypatch.setattr(near_copies, "LARGE", 4)
    monkeypatch.setattr(near_copies, "FREQUENT", 0)
    monkeypatch.setattr(near_copies, "FLUSH", 40)
    texts = some_texts()
    docs = frame(spark, [(i, t, "en", "s", len(t), *["x"] * 8) for i, t in enumerate(texts)])
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == set(brute_classes(texts))


def test_parities_never_differ_in_more_places_than_the_sets():
    rng = np.random.default_rng(1)
    for sizes in ((0, 3), (5, 6), (400, 700), (3000, 200), (9000, 8800)):
        common = rng.integers(0, 2**63, min(sizes) // 2, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common), dtype=np.uint64)])) for n in sizes)
        assert near_copies.apart(near_copies._parity(a), near_copies._parity(b)) <= len(np.setxor1d(a, b))
        assert near_copies.apart(near_copies._parity(a), near_copies._parity(a)) == 0


def test_prefixes_of_similar_sets_meet():
    random.seed(3)
    for _ in range(300):
        both = random.sample(range(10**9), random.randrange(1, 200))
        own = [np.array(sorted({*both, *random.sample(range(10**9), random.randrange(1 + len(both) // 8))}), np.uint64) for _ in range(2)]
        frequent = np.sort(np.array(random.sample(both, len(both) // 2), np.uint64))
        rank = np.array([random.randrange(2, 9) for _ in frequent])
        shared = len(np.intersect1d(*own))
        if 100 * shared >= 80 * (len(own[0]) + len(own[1]) - shared):
            first = [near_copies._prefix(x, frequent, rank) for x in own]
            assert len(np.intersect1d(*first)) and abs(int(near_copies.size_code(len(own[0]))) - int(near_copies.size_code(len(own[1])))) <= 9


def test_close_pairs_lose_no_similar_pair():
    """At their first shared shingle, similar sets of different classes are a pair, whole or cut into two chunks."""
    random.seed(4)
    word = lambda: random.randrange(1, 2**63)
    base = [word() for _ in range(random.choice((30, 90)))]
    sets = []
    for _ in range(60):
        own = set(base) - set(random.sample(base, random.randrange(len(base) // 4)))
        sets.append(np.array(sorted(own | {word() for _ in range(random.randrange(len(base) // 4))}), np.uint64))
    none = np.array([], np.uint64), np.array([], np.int64)
    first = [near_copies._prefix(s, *none) for s in sets]
    similar = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
    kind = np.array([random.choice((7, 7, 7, i)) for i in range(len(sets))])
    want = {(i, j) for i in range(len(sets)) for j in range(i) if kind[i] != kind[j] and similar(sets[i], sets[j])}
    n, bits = np.array([len(s) for s in sets]), np.array([near_copies._parity(s) for s in sets], object)
    for split in (False, True):
        got = set()
        for sig in {int(x) for f in first for x in f}:
            at = [i for i, f in enumerate(first) if sig in f]
            code = np.array([near_copies.place_codes(len(sets[i]), len(first[i]))[list(first[i]).index(sig)] for i in at], np.int64)
            rows = np.array(at), n[at], kind[at], code, bits[at]
            parts = [np.arange(len(at))[k::2] for k in range(2)] if split else [np.arange(len(at))]
            for x in range(len(parts)):
                for y in range(x, len(parts)):
                    if len(parts[x]) and len(parts[y]):
                        for a, b in near_copies._close_pairs(rows, parts[x], parts[y], x == y, False):
                            got |= {(max(p), min(p)) for p in zip(a.tolist(), b.tolist())}
        assert want <= got and want and all(kind[i] != kind[j] for i, j in got)


def test_clashing_columns_and_repeated_rows_stay_whole(spark):
    from .texts import PROSE

    out = near_copies.keep_one(frame(spark))
    assert out.schema == SCHEMA
    rows = out.collect()
    assert [r.doc_id for r in rows if r.text == PROSE * 3] == [5] and all(r.score == "clash" for r in rows)
    assert near_copies.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_edge_rows(spark):
    docs = frame(spark)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    classes = brute_classes([r.text for r in rows])
    got = near_copies.keep_one(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(rows[k].doc_id for k in set(classes))


def test_few_links_take_one_task_and_no_star_steps(spark, monkeypatch):
    """Each plan costs the driver memory that its JVM keeps, so small tables mustn't be planned in dozens of steps."""
    names, write = [], near_copies.common.materialise
    monkeypatch.setattr(near_copies.common, "materialise", lambda df, name: names.append(name) or write(df, name))
    texts = some_texts()
    rows = [(i, t, "en", "s", len(t), *["x"] * 8) for i, t in enumerate(texts)]
    kept = [r.doc_id for r in near_copies.keep_one(frame(spark, rows)).collect()]
    assert sorted(kept) == sorted(set(brute_classes(texts)))
    assert not {"large-star", "small-star"} & set(names), names
    assert len(names) <= 32, names


def test_classes_are_the_same_by_one_task_and_by_star_steps(spark, monkeypatch):
    rng = random.Random(4)
    chain = list(range(-40, 40))
    rng.shuffle(chain)  # a long path whose labels are in no order
    links = [*zip(chain, chain[1:]), *((100, 100 + k) for k in range(1, 9)), *((300, 300 - k) for k in range(1, 9)), (500, 500), (2**62, -(2**62))]
    links += [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(45)]
    parent = {x: x for pair in links for x in pair}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in links if a != b for x in (a, b)}
    for block in (near_copies.BLOCK, 0):
        monkeypatch.setattr(near_copies, "BLOCK", block)
        got = near_copies.classes_of(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()
        assert sorted((r.node, r.root) for r in got) == sorted((x, root(x)) for x in linked)
        assert near_copies.classes_of(spark.createDataFrame([], "a long, b long")).count() == 0
