import random
import struct
import zlib
from collections import Counter

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomdex.llm import packing, pretoken, token_counts

from .texts import SCHEMA, frame

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


FIRST = token_counts.LengthTable(["the", "s", "İ"], [1, 1, len(LIBRARY.encode("İ", add_special_tokens=False).ids)])


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


CHARS = st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("aBé'sİΣς́̇ \n\t\x0b\x1c\x85\xa0²½.,!|<>")), st.sampled_from(["<|endoftext|>", "'ve", "'LL", "the ", "Ünïcode "]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(CHARS, max_size=30).map("".join), max_size=4))
def test_pretokens_give_the_librarys_ids(texts):
    encoder = pretoken.PretokenEncoder(PATH, "test", list)
    assert [[i for w in x for i in w] for x in encoder.values(texts)] == [ids(t) for t in texts]
    counter = pretoken.PretokenEncoder(PATH, "counts", len, FIRST)
    assert [sum(x) for x in counter.values(texts)] == [len(ids(t)) for t in texts]


def test_length_table_holds_its_words_and_no_others(monkeypatch):
    words = [f"w{i}" for i in range(500)] + ["é", "漢字", "the"]
    table = token_counts.LengthTable(words, [len(w) for w in words])
    assert table.lookup([*words, "no", "W1", ""]) == {w: len(w) for w in words}
    assert token_counts.LengthTable([], []).lookup(["a"]) == {} and table.lookup([]) == {}
    monkeypatch.setattr(token_counts.xxhash, "xxh64_intdigest", lambda b: len(b))  # most words collide
    table = token_counts.LengthTable(words, [len(w) for w in words])
    found = table.lookup([*words, "no", "xxx"])
    assert found and all(n == len(w) and w in words for w, n in found.items())


def test_first_tier_is_bounded_and_frequent(spark):
    docs = spark.createDataFrame([("often seldom" + str(i) + " often " + " ".join(f"{chr(97 + k % 26) * (1 + k // 26)}q" for k in range(600)) + " often" * 3,) for i in range(300)], "text string")
    words = token_counts.frequent_pretokens(docs, size=10, sample=200)
    assert words[0] == "often" and len(words) == 10
    assert len(token_counts.frequent_pretokens(docs, sample=200)) <= token_counts.PER_TEXT + 12
    assert token_counts.frequent_pretokens(docs.limit(0)) == []


def test_generations_forget_and_find_again(monkeypatch):
    monkeypatch.setattr(pretoken, "CACHE", 5)
    encoder = pretoken.PretokenEncoder(PATH, "small", list)
    random.seed(1)
    for _ in range(30):
        text = " ".join(random.choice("abcdefghijklmnop") * 3 for _ in range(6)) + " " + "x" * 90
        assert [i for w in encoder.values([text])[0] for i in w] == ids(text)
    assert len(encoder.generations[0]) <= 12


def test_token_counts(spark):
    df = frame(spark)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df, PATH).collect())
    assert got == Counter((r.doc_id, len((r.text or "").encode()), n := len(ids(r.text)), n > 2048) for r in df.collect())
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_packing_places_every_piece_once(spark):
    df = frame(spark)
    packed = packing.pack_documents(df, PATH, with_ids=True)
    want = Counter()
    for r in df.collect():
        all_ids = [*ids(r.text), 0]
        for k, at in enumerate(range(0, len(all_ids), 2048)):
            piece = all_ids[at : at + 2048]
            want[r.doc_id, k, at, len(piece), zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))] += 1
    rows = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    whole = {r.sequence_id: r.ids for r in packing.assemble(packed).collect()}
    for s in {r.sequence_id for r in rows}:
        own = sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            assert struct.pack(f"<{r.length}I", *whole[s][at : at + r.length]) == bytes(r.ids)
            at += r.length
        assert at <= 2048
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plans_use_up_counts_within_capacity(counts):
    plan = packing.plan_packing(counts, 64)
    used = Counter()
    for times, parts in plan:
        assert times > 0 and sum(length * k for length, k in parts) <= 64
        for length, k in parts:
            used[length] += times * k
    assert used == Counter(counts)
    sequences = sum(t for t, _ in plan)
    assert sequences >= packing.lower_bound(counts, 64)
    total = sum(k * v for k, v in counts.items())
    assert sequences <= 2 * total / 64 + 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=20, max_size=20), st.integers(1, 19))
def test_complements_are_found_when_they_exist(n, gap):
    import numpy as np

    counts = np.array([0, *n[1:]])
    index = packing.ComplementIndex(counts)
    lengths = [x for x in range(1, 20) for _ in range(int(counts[x]))]
    from itertools import combinations

    for size, find in ((1, index.single), (2, index.pair), (3, index.triple)):
        exists = any(sum(c) == gap for c in combinations(lengths, size))
        got = find(gap)
        assert (got is not None) == exists
        if got:
            assert sum(got) == gap and index.fits(got)


def test_large_counts_pack_tightly():
    random.seed(2)
    counts = {random.randrange(1, 2048): random.randrange(1, 10**9) for _ in range(900)}
    plan = packing.plan_packing(counts)
    assert sum(t for t, _ in plan) <= 1.01 * packing.lower_bound(counts) or sum(v for k, v in counts.items() if k > 1024) > packing.lower_bound(counts)
    assert len(plan) < 20_000


def test_pack_keeps_other_columns(spark):
    own = ["name", "_row", "_part", "_place", "_at", "_arc", "data", "offset", "a.b"]
    cut = spark.createDataFrame([(1 + i * 7 % 90, *[f"{c}{i}" for c in own]) for i in range(50)], ["length", *own])
    out = packing.pack(cut, 100)
    assert out.columns == ["length", *[c for c in own if c != "offset"], "sequence_id", "offset"]
    assert {(r["_row"], r["a.b"]) for r in out.collect()} == {(f"_row{i}", f"a.b{i}") for i in range(50)}
    ends = Counter()
    for r in sorted(out.collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert ends[r.sequence_id] == r.offset
        ends[r.sequence_id] += r.length
    assert sum(ends.values()) == sum(1 + i * 7 % 90 for i in range(50)) and max(ends.values()) <= 100
