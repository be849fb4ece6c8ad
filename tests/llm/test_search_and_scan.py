import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from loomdex.llm import licenses, sentencepieces, topk

from .texts import SCHEMA, frame

VECTORS = "vec_id long, embedding array<double>, label int, score string, x int"


def brute_top(rows, every=100, k=10):
    """All pairs with Python's integers; scores end at the ends of the range."""
    whole = lambda v: tuple(math.floor(Fraction(x) * 1024) for x in v)
    good = {(i, whole(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    clip = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    out = []
    for qid in sorted({i for i, _ in good if i % every == 0}):
        found = {(-clip(sum(a * b for a, b in zip(q, c))), i) for j, q in good if j == qid for i, c in good if i != qid and len(c) == len(q)}
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", 1) for i, v in rows], VECTORS).repartition(3)


def run(spark, rows, **more):
    df = vectors(spark, rows)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df.filter("vec_id % 100 = 0"), df, **more).collect())


def test_top_k_matches_brute_force_on_edge_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.3, 7).tolist()) for i in range(260)]
    rows += [(300, None), (400, [None] + [0.1] * 6), (500, [float("nan")] * 7), (600, [float("inf")] * 7), (None, [0.1] * 7), (700, []), (701, []), (800, [0.5, 0.5]), (801, [0.5, 0.25])]
    rows += [(1000 + i, [0.2] * 7) for i in range(40)] + rows[:3]
    assert run(spark, rows) == brute_top(rows)
    assert run(spark, rows, block_bytes=200) == brute_top(rows)
    assert run(spark, []) == []


@pytest.mark.parametrize("size", [1e6, 1e7, 1e10, 1e150, 1e300, 1.7e308])
def test_large_components_lose_no_result(spark, size):
    """Products beyond float64's exact range, beyond a long and beyond float64 itself, among ordinary rows and other lengths."""
    rng = np.random.default_rng(int(np.log10(size)))
    rows = [(i, rng.normal(0, 0.5, 3).tolist()) for i in range(1, 60)] + [(100, rng.normal(0, 0.5, 3).tolist())]
    rows += [(0, [size, 3.0, -2 * size if size < 1e308 else -size]), (200, [1.0, size, 1.0]), (201, [size + 1 / 1024, 1.0, 1.0]), (202, [size, 2.0, 1.0]), (203, [-size, size, 0.5])]
    rows += [(300, [size, 1.0]), (301, [size, -size]), (302, [0.5, 0.25]), (400, [size] * 20), (401, [-size / 3] * 20), (402, [0.1] * 20)]
    assert run(spark, rows) == brute_top(rows)
    assert run(spark, rows, block_bytes=100) == brute_top(rows)


def test_hot_id_with_many_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(500, rng.normal(0, 0.3, 4).tolist()) for _ in range(60)] + [(i, rng.normal(0, 0.3, 4).tolist()) for i in range(100, 220)]
    assert run(spark, rows, block_bytes=400) == brute_top(rows)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    q, x = np.floor(rng.normal(0, 200, (20, 64))), np.floor(rng.normal(0, 200, (300, 64)))
    exact = q @ x.T
    last = None
    for s in topk.LEVELS:
        bound = topk.segment_features(q, s) @ topk.segment_features(x, s).T
        assert (bound >= exact - 1e-6).all()
        assert last is None or (bound <= last + 1e-6).all()
        last = bound
    centres = rng.normal(0, 200, (20, 64))
    near = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(0, 5, (2000, 64)))[rng.permutation(2000)]
    search = topk.Search(np.arange(20), np.floor(centres), 10, scale=1)
    for i in range(0, 2000, 100):
        search.add(np.arange(100 + i, 200 + i), near[i : i + 100])
    assert search.exact < search.bounded / 3


def brute_base(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


LICENSED = [
    "Licensed under CC BY-NC 4.0. cc by cc  BY",
    "mit license MIT LICENSE mit license",
    "GNU GPL; GNU General-Public/License, version 3. gnu general public license",
    "apache license" * 3,
    "é apache\xa0license",
]


def test_base_places_match_brute_force(spark):
    more = [(5000 + i, t, "en", "s", 1, *["c"] * 8) for i, t in enumerate(LICENSED)]
    df = frame(spark).unionByName(spark.createDataFrame(more, SCHEMA))
    out = licenses.license_scan(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out) == Counter((r.doc_id, *brute_base(r.text)) for r in df.collect())
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in out)
    assert licenses.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0


MARKS = re.compile(r"<<(optional|end|any (\d+)|one ([^>]*))>>")


def as_pattern(template):
    """The template as a regular expression over words that each end in a space."""
    run = lambda t: "".join(re.escape(w.decode()) + " " for w in licenses.words_of(t))
    out, end = "", 0
    for m in MARKS.finditer(template):
        out += run(template[end : m.start()])
        end = m.end()
        out += "(?:" if m[1] == "optional" else ")?" if m[1] == "end" else f"(?:[^ ]+ ){{0,{m[2]}}}" if m[2] else "(?:" + "|".join(map(run, m[3].split("|"))) + ")"
    return out + run(template[end:])


def written_out(template, rng):
    """The template with each region drawn at random."""
    out, end, skipped = [], 0, 0
    for m in MARKS.finditer(template):
        out += [] if skipped else licenses.words_of(template[end : m.start()])
        end = m.end()
        if m[1] == "optional":
            skipped += bool(skipped or rng.random() < 0.4)
        elif m[1] == "end":
            skipped -= bool(skipped)
        elif not skipped:
            out += [b"acme"] * int(rng.integers(0, int(m[2]) + 1)) if m[2] else licenses.words_of(m[3].split("|")[int(rng.integers(0, m[3].count("|") + 1))])
    return out + licenses.words_of(template[end:])


def brute_matches(words, templates):
    """The longest match of each label at each place, trying every stretch of words."""
    found = []
    for a in range(len(words)):
        for label in sorted(templates):
            last = [b for b in range(a, len(words)) for t in templates[label] if re.fullmatch(as_pattern(t), b" ".join(words[a : b + 1]).decode() + " ")]
            found += [(label, a, max(last))] if last else []
    return found


@pytest.mark.parametrize("label", sorted(licenses.MENTIONS))
def test_mentions_match_brute_force(label):
    rng = np.random.default_rng(len(label))
    automaton = licenses.Automaton(licenses.MENTIONS)
    for _ in range(12):
        words = [b"text", *written_out(licenses.MENTIONS[label][0], rng), b"and", *written_out(licenses.MENTIONS[label][-1], rng), b"more"]
        for k in rng.integers(0, len(words), 2 * int(rng.integers(0, 2))):
            words[k : k + 1] = ([], [b"other"], [words[k], b"other"])[int(rng.integers(0, 3))]
        assert automaton.matches(words) == brute_matches(words, licenses.MENTIONS)


@pytest.mark.parametrize("label", sorted(licenses.TEMPLATES))
def test_templates_match_brute_force_and_accept_nothing_less(label):
    """Whole wordings are accepted however their regions are filled; with a mandatory word changed, dropped or added they are not."""
    rng = np.random.default_rng(len(label))
    (template,) = licenses.TEMPLATES[label]
    only, every = licenses.Automaton({label: [template]}), licenses.Automaton(licenses.TEMPLATES)
    pattern = re.compile(as_pattern(template))
    for _ in range(6):
        own = written_out(template, rng)
        assert pattern.fullmatch(b" ".join(own).decode() + " ")
        assert label in {x for x, _, _ in every.matches([b"before", *own, b"after"])}
        for k in rng.integers(0, len(own), 8):
            for new in ([], [b"other"], [own[k], b"other"]):
                words = [*own[:k], *new, *own[k + 1 :]]
                text = b" ".join(words).decode() + " "
                # A mandatory first word bounds the places, the longest match is what the expression can reach.
                want = [(label, a, b) for a in range(len(words)) if words[a] in only.first for b in [max((b for b in range(len(words)) if b >= a and pattern.fullmatch(" ".join(w.decode() for w in words[a : b + 1]) + " ")), default=None)] if b is not None] if pattern.search(text) else []
                assert only.matches(words) == want


@pytest.mark.parametrize(
    "text",
    [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: pay me",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies. THE SOFTWARE IS PROVIDED 'AS IS' AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "This is not licensed under the MIT license",
        "This is free and unencumbered software released into the public domain.",
    ],
)
def test_partial_wordings_and_negations_are_not_accepted(spark, text):
    (r,) = licenses.license_scan(frame(spark, [(1, text, "en", "s", 1, *["c"] * 8)])).collect()
    assert r.score <= 0.5 and not r.spans and r.labels == r.base_labels


def test_mentions_are_a_weaker_kind(spark):
    texts = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3."]
    rows = licenses.license_scan(frame(spark, [(i, t, "en", "s", 1, *["c"] * 8) for i, t in enumerate(texts)])).collect()
    assert {r.doc_id: (r.score, r.labels) for r in rows} == {0: (0.75, "mention:MIT,mit"), 1: (0.75, "cc-by,mention:CC-BY-NC-4.0"), 2: (0.75, "gpl,mention:GPL")}


def test_spans():
    automaton = licenses.Automaton({"x": ["alpha <<optional>>very<<end>> beta <<any 2>> gamma", "alpha beta"]})
    find = lambda t: automaton.matches(licenses.words_of(t))
    assert find("o alpha very beta one two gamma") == [("x", 1, 6)]
    assert find("alpha beta") == [("x", 0, 1)] and find("alpha very beta one two three gamma") == []
    assert find("alpha alpha beta") == [("x", 1, 2)]
    with pytest.raises(ValueError):
        licenses.Automaton({"x": ["<<any 3>> alpha"]})


PATH = public_tokenizers.path("piece_bpe_32k.model")
CODEC = sentencepieces.Codec.of_worker(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def decoded_ids(data):
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.characters(codec="utf-8"), st.sampled_from(["a", " ", "  ", "the ", "\n", "--", "▁", "é", "漢", "😀", "<s>"])), max_size=40).map("".join))
def test_codec_is_the_library(text):
    ((data, decoded, _),) = CODEC.encode([text])
    ids = decoded_ids(data)
    assert ids == LIBRARY.encode(text)
    assert decoded == LIBRARY.decode(ids) == CODEC.decode([ids])[0]


def test_the_backends_ids_are_the_result_and_wrong_ones_are_seen(monkeypatch):
    text = "The quick brown fox, again and again 漢字 \u0007 fox"
    with open(PATH, "rb") as f:
        data = f.read()
    codec = sentencepieces.Codec(data)
    asked = []
    monkeypatch.setattr(codec, "_library_ids", lambda cuts, found: asked.extend(cuts) or found)
    ((ids, decoded, agree),) = codec.encode([text])
    assert decoded_ids(ids) == LIBRARY.encode(text) and decoded == text and agree and asked  # no id of the library's was used
    wrong = sentencepieces.Codec(data)
    honest = wrong._backend_ids
    monkeypatch.setattr(wrong, "_backend_ids", lambda cuts: [x[:-1] if len(x) > 1 else x for x in honest(cuts)])
    ((ids, decoded, agree),) = wrong.encode([text])
    assert not agree and wrong.fallbacks and decoded_ids(ids) == LIBRARY.encode(text) and decoded == text
    monkeypatch.setattr(sentencepieces, "CACHE", 3)
    for _ in range(3):  # what is odd stays so after the cache has turned
        assert wrong.encode([text, "other words"])[0] == (ids, text, False)
    assert CODEC.encode([text])[0][2] and not CODEC.fallbacks


def test_very_long_texts_are_encoded_whole():
    text = "word and more " * 20_000 + "x" * 5000
    ((ids, decoded, agree),) = CODEC.encode([text])
    assert decoded_ids(ids) == LIBRARY.encode(text) and decoded == text and agree


def test_whole_backend_agrees_on_prose():
    for text in ("The quick brown fox, déjà vu.\nNew line  two spaces", "x" * 300, "¡Hola! 漢字"):
        assert CODEC.whole.encode(text, add_special_tokens=False).ids == LIBRARY.encode(text)


def test_sentencepiece_round_trips(spark):
    import zlib

    df = frame(spark)
    got = Counter((r.doc_id, r.n_ids, r.ids_crc32, r.decoded_crc32, r.round_trip) for r in sentencepieces.round_trips(df, PATH).collect())
    want = Counter()
    for r in df.collect():
        ids = LIBRARY.encode(r.text or "")
        back = LIBRARY.decode(ids)
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32(back.encode()), back == (r.text or "").replace("▁", " ")] += 1
    assert got == want
    both = df.select("text", sentencepieces.encoder(PATH)("text").alias("ids")).withColumn("back", sentencepieces.decoder(PATH)("ids")).collect()
    assert all(r.back == (r.text or "") and r.ids == LIBRARY.encode(r.text or "") for r in both)


def test_unigram_models_are_rebuilt(tmp_path):
    spec = sentencepieces.Spec([("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("▁ab", -1.0, 1), ("ab", -1.5, 1)], kind=1)
    backend = sentencepieces.backend(spec)
    assert backend.encode("ab  abab", add_special_tokens=False).tokens == ["▁ab", "▁ab", "ab"]
    assert backend.decode(backend.encode("ab abab", add_special_tokens=False).ids) == "ab abab"
