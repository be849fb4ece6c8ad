"""Operator 4: license scans by template-markup matching.

Templates (``license_texts``) are compiled into one automaton over words: a mandatory word is an edge,
an optional region can be stepped over, a replaceable region is a bounded run of any words or a
choice.  A text is accepted at a place where every mandatory word stands exactly and in order; a template holds
the whole wording of a licence or of the notice it prescribes.  The automaton runs from each word that can begin a
template; sets of states and what a word makes of them are remembered, so it becomes deterministic as it is used.

One-line mentions ("released under the ... license") are markup as well, but a weaker kind: their labels begin with
``mention:``, and one that follows a negation within NEAR words is none.  Base phrases are searched beside both.

A map over whole texts: nothing is shuffled or gathered.

Defined results: the score is 1 for an accepted template, 0.75 for a mention, 0.5 for a base phrase, else 0; a null
text has no words; without any place the word numbers are null and labels are empty strings; of matches of one label
that begin at one word the longest counts, and ties between labels all do; very long texts are scanned whole; repeated
rows are scanned each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .license_texts import MENTIONS, TEMPLATES

#: Fixed values of the base scan: phrase and label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Words that take a mention back, and how many words before it are looked at.
NEGATIONS, NEAR = frozenset((b"not", b"never", b"no", b"neither", b"nor", b"without", b"cannot", b"isn", b"wasn", b"aren", b"unless")), 4
#: Remembered steps of the automaton; when they are full they start anew.
STEPS = 100_000

_FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_MARK = re.compile(r"<<(optional|end|any (\d+)|one ([^>]*))>>")


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, with A-Z in lower case."""
    return (text or "").encode().translate(_FOLD).split()


class Automaton:
    """States of all templates; ``accepts`` maps a state to its label."""

    def __init__(self, templates: dict[str, list[str]]):
        self.words: list[dict[bytes, list[int]]] = []
        self.any: list[list[int]] = []
        self.skip: list[list[int]] = []
        self.accepts: dict[int, str] = {}
        starts = []
        for label, texts in templates.items():
            for text in texts:
                start = self._state()
                starts.append(start)
                self.accepts[self._compile(text, start)] = label
        self.start = self._closure(starts)
        self.first = {w for s in self.start for w in self.words[s]}
        if any(self.any[s] for s in self.start) or not self.start.isdisjoint(self.accepts):
            raise ValueError("a template must begin with a mandatory word")
        self.steps: dict[tuple[frozenset, bytes], frozenset] = {}

    def _state(self) -> int:
        self.words.append({})
        self.any.append([])
        self.skip.append([])
        return len(self.words) - 1

    def _run(self, text: str, at: int) -> int:
        for w in words_of(text):
            new = self._state()
            self.words[at].setdefault(w, []).append(new)
            at = new
        return at

    def _compile(self, text: str, at: int) -> int:
        open_: list[int] = []
        end = 0
        for m in _MARK.finditer(text):
            at = self._run(text[end : m.start()], at)
            end = m.end()
            if m[1] == "optional":
                open_.append(at)
            elif m[1] == "end":
                self.skip[open_.pop()].append(at)
            elif m[2]:
                chain = [at, *(self._state() for _ in range(int(m[2])))]
                at = self._state()
                for a, b in zip(chain, chain[1:]):
                    self.any[a].append(b)
                for a in chain:
                    self.skip[a].append(at)
            else:
                ends = [self._run(choice, at) for choice in m[3].split("|")]
                at = self._state()
                for e in ends:
                    self.skip[e].append(at)
        if open_:
            raise ValueError("an optional region isn't closed")
        return self._run(text[end:], at)

    def _closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def step(self, states: frozenset, word: bytes) -> frozenset:
        key = (states, word)
        if key not in self.steps:
            if len(self.steps) >= STEPS:
                self.steps.clear()
            self.steps[key] = self._closure({n for s in states for n in (*self.words[s].get(word, ()), *self.any[s])})
        return self.steps[key]

    def matches(self, words: list[bytes]) -> list[tuple[str, int, int]]:
        """(label, first word, last word) of the longest match of each label at each place."""
        if self.first.isdisjoint(words):
            return []
        found = []
        for at, w in enumerate(words):
            if w not in self.first:
                continue
            states, longest, end = self.start, {}, at
            while states and end < len(words):
                states = self.step(states, words[end])
                for s in states & self.accepts.keys():
                    longest[self.accepts[s]] = end
                end += 1
            found += [(label, at, last) for label, last in sorted(longest.items())]
        return found


def base_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[str, int]]:
    """(label, first word) of every place of a phrase."""
    text = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in phrases.items():
        find = b" " + phrase.encode() + b" "
        at, counted, word = text.find(find), 0, 0
        while at >= 0:
            word += text.count(b" ", counted, at)
            counted = at
            found.append((label, word))
            at = text.find(find, at + 1)
    return found


_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", _SPAN)])


def found_licenses(words: list[bytes], full: Automaton, mentions: Automaton) -> list[tuple[str, int, int]]:
    """(label, first word, last word) of templates and mentions."""
    said = [(f"mention:{label}", a, b) for label, a, b in mentions.matches(words) if NEGATIONS.isdisjoint(words[max(0, a - NEAR) : a])]
    return sorted(full.matches(words) + said, key=lambda s: (s[1], s[2], s[0]))


def _scanner(templates: dict[str, list[str]], phrases: dict[str, str], mentions: dict[str, list[str]]):
    def run(batches):
        full, weak = Automaton(templates), Automaton(mentions)
        heads = [p.encode().split()[0] for p in phrases]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                places = base_places(words, phrases) if any(map(words.__contains__, heads)) else []
                spans = found_licenses(words, full, weak)
                score = 0.0 if not spans else 1.0 if any(":" not in s[0] for s in spans) else 0.75
                base = {label for label, _ in places}
                at = [w for _, w in places]
                rows.append((doc_id, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s[0] for s in spans})), max(score, 0.5 if at else 0.0), [dict(zip(("label", "first", "last"), s)) for s in spans]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return run


def license_scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, mentions: dict[str, list[str]] = MENTIONS) -> DataFrame:
    """One row per document with counts, labels, score and the spans of accepted templates and mentions."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long>>"
    return rows.mapInArrow(_scanner(templates, phrases, mentions), schema)
