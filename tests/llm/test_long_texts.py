"""Every operator reads a text of a megabyte whole: what it gives depends on the last word."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomdex.llm import language_id, licenses, near_copies, packing, quality_classifier, quality_rules, sentencepieces, sharding, simhash, token_counts

from .test_quality_rules import brute
from .test_simhash import brute_fingerprint
from .texts import frame

PATH, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts():
    random.seed(12)
    words = [f"w{random.randrange(40_000)}" for _ in range(150_000)]
    lines = "\n".join(" ".join(words[i : i + 30]) for i in range(0, len(words), 30))
    return {1: lines + " end released under the MIT license", 2: lines + " end", 3: lines.replace("w1 ", "v1 ") + " end", 4: "short text"}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, [(i, t, "en", "s", len(t), *["c"] * 8) for i, t in texts.items()])


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_tokens_and_pieces(docs, texts):
    library = Tokenizer.from_file(PATH)
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    counts = by_id(token_counts.token_counts(docs, PATH))
    assert {i: r.n_tokens for i, r in counts.items()} == want and counts[1].n_bytes == len(texts[1])
    lengths = {}
    for r in packing.pack_documents(docs, PATH).collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {i: n + 1 for i, n in want.items()}
    trips = by_id(sentencepieces.round_trips(docs, PIECES))
    assert all(r.round_trip and r.parity for r in trips.values()) and trips[1].n_ids > trips[2].n_ids > 150_000


def test_words_and_places(docs, texts):
    rows = by_id(licenses.license_scan(docs))
    assert rows[1].n_words == len(texts[1].split()) and rows[1].first_word == rows[1].last_word == len(texts[1].split()) - 2 and rows[1].labels == "mention:MIT,mit"
    rules = by_id(quality_rules.quality_rules(docs))
    for i, t in texts.items():
        r = rules[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t)
    assert {i: r.size for i, r in by_id(sharding.shard_documents(docs)).items()} == {i: len(t) + 1 for i, t in texts.items()}


def test_copies(docs, texts):
    rows = by_id(simhash.near_duplicates(docs))
    assert {i: r.fingerprint for i, r in rows.items()} == {i: f"{brute_fingerprint(t):016x}" for i, t in texts.items()}
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == {1, 4}


def test_models(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality_classifier.classify(docs, labels).collect())
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()} == dict.fromkeys(range(1, 5), "en")
