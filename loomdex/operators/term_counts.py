"""Terms of documents counted in Python workers, a document at a time: the rules of ``functions.tokens``, over Arrow batches.

Column expressions make an object of every emission and sort them; here each distinct run of characters is cut into
terms once, and a document costs a regular expression and a dictionary.  Terms hold only ASCII and CJK characters, so
texts stay UTF-8 bytes unless CJK characters may stand in them.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import add

import numpy as np
import pyarrow as pa

from ..functions.tokens import CJK, COMPOUND, query_tokens

#: Fields in the order of their names, and the lines that are kept of a term.
FIELDS = ("alias", "body", "catalog", "path", "title")
LINES = 8
#: The two kinds of runs, which share no character, and the first bytes of all CJK characters in UTF-8.
_IDENTIFIER, _CJK_RUN, _MAYBE_CJK = re.compile(rb"[A-Za-z0-9_][A-Za-z0-9_.]*"), re.compile(f"[{CJK}]+"), re.compile(b"[\xe3-\xe9\xef]")
_COMPOUND, _CJK_RANGES = re.compile(COMPOUND.encode()), [(ord(CJK[i]), ord(CJK[i + 2])) for i in (0, 3)]
_ENDS = re.compile(b"\r\n?")
#: Runs whose terms a worker remembers, the longest of them, and rows in one batch that goes back.
CACHED, CACHED_LENGTH, ROWS = 1 << 16, 64, 1 << 16
#: Texts of fewer characters have their CJK terms counted without arrays.
SHORT = 512


class _Terms(dict):
    """The terms of an identifier, repeats included."""

    def __missing__(self, run: bytes) -> tuple[bytes, ...]:
        if not _COMPOUND.search(run):
            return (run.lower(),)
        made = tuple(t.encode() for t in query_tokens(run.decode()) if t)
        if len(run) <= CACHED_LENGTH:
            if len(self) >= CACHED:
                self.clear()
            self[run] = made
        return made

    def count(self, text: bytes) -> dict[bytes, int]:
        """How often each term occurs in ``text``; most identifiers are in lower case, without parts, and so are their own term."""
        found = Counter(_IDENTIFIER.findall(text))
        others = [(r, found.pop(r)) for r in [r for r in found if not (r.isalnum() and (r.islower() or r.isdigit()))]]
        for run, n in others:
            for t in self[run]:
                found[t] = found.get(t, 0) + n
        if not text.isascii() and _MAYBE_CJK.search(text):
            found.update({t.encode(): n for t, n in _cjk_counts(text.decode("utf-8", "replace"))})
        return found


def _cjk_counts(text: str) -> Iterator[tuple[str, int]]:
    """How often each CJK character, and each pair within a run, occurs; arrays pay from some hundred characters on."""
    if len(text) < SHORT:
        runs = "\n".join(_CJK_RUN.findall(text))
        for grams in (Counter(runs), Counter(map(add, runs, islice(runs, 1, None)))):
            yield from ((t, n) for t, n in grams.items() if "\n" not in t)
        return
    codes = np.frombuffer(text.encode("utf-32-le"), np.dtype("<u4"))
    held = np.zeros(len(codes), bool)
    for first, last in _CJK_RANGES:
        held |= (codes >= first) & (codes <= last)
    both, wide = held[:-1] & held[1:], codes.astype("<u8")
    for width, grams in ((1, codes[held]), (2, wide[:-1][both] | wide[1:][both] << np.uint64(32))):
        found, counts = np.unique(grams, return_counts=True)
        letters = found.tobytes().decode("utf-32-le")
        yield from zip((letters[k : k + width] for k in range(0, len(letters), width)), counts.tolist())


def _body(text: bytes | None, lines: list | None, numbered: bool) -> Iterator[tuple[int, bytes]]:
    """(number, line) of a body; if numbers aren't asked for, all of it at once."""
    if lines is None:
        if text is None:
            return
        if not numbered:
            yield 1, text
            return
        lines = (_ENDS.sub(b"\n", text) if b"\r" in text else text).split(b"\n")
    for i, line in enumerate(lines, 1):
        if line:
            yield i, line


def _list_of(values: pa.Array, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def counter(key: str, columns: tuple[str, ...]):
    """A map of batches (``key``; text or lines; path, title, catalog and alias if there) to term, ``key`` and ``columns``."""
    with_fields, with_lines = "fields" in columns, "lines" in columns

    def run(batches):
        terms_of = _Terms()
        subsets = pa.array([[f for i, f in enumerate(FIELDS) if mask >> i & 1] for mask in range(1 << len(FIELDS))], pa.list_(pa.string()))
        bit = {f: 1 << i for i, f in enumerate(FIELDS)}

        def document(fields: list[tuple[str, bytes]], text: bytes | None, lines: list | None):
            parts = [(bit[f], 1, x) for f, x in fields] + [(bit["body"], i, x) for i, x in _body(text, lines, with_lines)]
            if len(parts) == 1:
                ((own, place, x),) = parts
                tf = terms_of.count(x)
                return tf, [own] * len(tf), [(place,)] * len(tf)
            tf, masks, places = {}, {}, {}
            for own, place, x in parts:
                for t, n in terms_of.count(x).items():
                    if t in tf:
                        tf[t] += n
                        if with_fields:
                            masks[t] |= own
                        if with_lines and len(known := places[t]) < LINES and known[-1] != place:
                            known.append(place)
                    else:
                        tf[t] = n
                        if with_fields:
                            masks[t] = own
                        if with_lines:
                            places[t] = [place]
            return tf, masks.values(), places.values()

        # No cycles are made here, and looking for them among millions of small lists takes a quarter of the time.
        gc.disable()
        try:
            for batch in batches:
                given = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                values = {n: _bytes(c) for n, c in given.items() if n != "_key"}
                terms, sizes, counts, masks, places = [], [], [], [], []
                for i in range(batch.num_rows):
                    fields = [(f, values[f][i]) for f in ("path", "title", "alias") if f in values and values[f][i]]
                    fields += [("catalog", x) for x in (values["catalog"][i] or () if "catalog" in values else ()) if x]
                    if "lines" in values:
                        text, lines = None, values["lines"][i] or []
                    else:
                        text, lines = values["text"][i], None
                    tf, own, at = document(fields, text, lines)
                    terms += tf
                    sizes.append(len(tf))
                    counts += tf.values()
                    if with_fields:
                        masks += own
                    if with_lines:
                        places += at
                made = {"term": pa.array(terms, pa.binary()).cast(pa.string()), key: given["_key"].take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))}
                if "tf" in columns:
                    made["tf"] = pa.array(counts, pa.int64())
                if with_fields:
                    made["fields"] = subsets.take(pa.array(masks, pa.int32()))
                if with_lines:
                    made["lines"] = _list_of(pa.array([x for own in places for x in own], pa.int32()), [len(x) for x in places])
                out = pa.RecordBatch.from_pydict(made)
                for start in range(0, out.num_rows, ROWS):
                    yield out.slice(start, ROWS)
        finally:
            gc.enable()

    return run


def _bytes(column: pa.Array) -> list:
    kind = column.type
    wide = pa.list_(pa.large_binary()) if pa.types.is_list(kind) or pa.types.is_large_list(kind) else pa.large_binary()
    return column.cast(wide).to_pylist()
