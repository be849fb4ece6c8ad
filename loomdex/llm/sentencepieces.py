"""Operator 7: SentencePiece encoding and decoding with the tokenizers library.

The model's protobuf is read here (no generated classes): pieces with scores and types, the
model type and the normaliser's settings.  From them a tokenizers backend is built (``backend``):

* normaliser: the model's character map, extra spaces removed if it says so, the metaspace marker
  for spaces and in front;
* model: ``Unigram`` with the pieces' scores, or ``BPE`` whose merges are the pairs of pieces that make
  a piece, best score first; both with byte fallback;
* decoder: marker to space, bytes joined, the front marker's space taken off.

No piece of a model that keeps words apart has a marker after another character, so texts can be cut in
front of each run of markers without changing an id (``separable``; models for which that doesn't
hold are encoded whole).  The cuts are encoded once per worker, in multithreaded batches, and the backend's ids
are the result.  Parity is verified cut by cut: the SentencePiece library encodes each fresh cut too, and a cut on
which the two differ (equal scores of overlapping pairs, which the library takes from the left) is set right,
counted (``Codec.fallbacks``) and its documents are marked.  A cut's ids are decoded by the backend once as well.

Defined results: null and empty texts have no ids and decode to the empty text; very long texts are encoded
whole, in memory of a few times their size (a cut of more than LONGEST characters isn't kept); repeated
rows are encoded each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from . import common

MARK = "▁"
#: Entries of each generation of a worker's cache, and the longest cut that is kept.
CACHE, LONGEST = 262_144, 64
#: Field numbers and types of the model's protobuf.
_PIECES, _TRAINER, _NORMALISER = 1, 2, 3
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _BPE = 1, 2


def _fields(data: bytes):
    """(field number, value) of a protobuf message: whole numbers, or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Spec:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = _UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == _UNKNOWN)


def parse(data: bytes) -> Spec:
    spec = Spec()
    for number, value in _fields(data):
        if number == _PIECES:
            own = dict(_fields(value))
            spec.pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, _NORMAL)))
        elif number == _TRAINER:
            own = dict(_fields(value))
            spec.kind, spec.byte_fallback = own.get(3, _UNIGRAM), bool(own.get(35, 0))
        elif number == _NORMALISER:
            own = dict(_fields(value))
            spec.charsmap, spec.prefix, spec.squeeze, spec.escape = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
    if spec.kind not in (_UNIGRAM, _BPE) or not spec.escape or any(p[2] == _USER for p in spec.pieces):
        raise ValueError("only unigram and BPE models with escaped spaces and without user-defined pieces can be rebuilt")
    return spec


def merges(spec: Spec) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, by its score; equal scores by the ids of the parts."""
    ids = {p: i for i, (p, _, t) in enumerate(spec.pieces) if t == _NORMAL}
    found = []
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            a, b = piece[:cut], piece[cut:]
            if a in ids and b in ids:
                found.append((-spec.pieces[i][1], ids[a], ids[b], a, b))
    return [(a, b) for *_, a, b in sorted(found)]


def separable(spec: Spec) -> bool:
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, t in spec.pieces if t == _NORMAL)


def backend(spec: Spec, bare: bool = False) -> Tokenizer:
    """The whole tokenizer, or one for text that is already normalised and cut."""
    names = [p for p, _, _ in spec.pieces]
    if spec.kind == _BPE:
        model = models.BPE(vocab={p: i for i, p in enumerate(names)}, merges=merges(spec), unk_token=names[spec.unknown], fuse_unk=True, byte_fallback=spec.byte_fallback)
    else:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], spec.unknown, spec.byte_fallback)
    out = Tokenizer(model)
    if not bare:
        steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
        if spec.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        steps += [normalizers.Prepend(MARK)] if spec.prefix else []
        out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        if separable(spec):
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if spec.prefix and not bare else [])])
    return out


class Codec:
    """Encodes and decodes texts; keeps the cuts that it has seen, in two generations."""

    _of_worker: dict[str, Codec] = {}

    def __init__(self, data: bytes):
        import sentencepiece

        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        self.spec = parse(data)
        self.whole, self.bare = backend(self.spec), backend(self.spec, bare=True)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+") if separable(self.spec) else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: Cuts that don't decode to themselves or on which the backend differs: what they decode to, and whether it agrees.
        self.odd: dict[str, tuple[str, bool]] = {}
        self.fallbacks = 0

    @classmethod
    def of_worker(cls, path: str) -> Codec:
        if path not in cls._of_worker:
            with open(path, "rb") as f:
                cls._of_worker[path] = cls(f.read())
        return cls._of_worker[path]

    def normalised(self, text: str | None) -> str:
        if not text:
            return ""
        if self.spec.charsmap or self.spec.squeeze:
            return self.whole.normalizer.normalize_str(text)
        return (MARK if self.spec.prefix else "") + text.replace(" ", MARK)

    def _cut(self, normal: str) -> list[str]:
        return self.cut.findall(normal) if self.cut else [normal] if normal else []

    def cuts(self, text: str | None) -> list[str]:
        return self._cut(self.normalised(text))

    def _backend_ids(self, cuts: list[str]) -> list[list[int]]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        return [e.ids for e in self.bare.encode_batch_fast(cuts, add_special_tokens=False)]

    def _library_ids(self, cuts: list[str], found: list[list[int]]) -> list[list[int]]:
        """The library's ids where it can be asked for a cut alone, else those that were found."""
        plain = [(c[1:] if self.spec.prefix and c[0] == MARK else c).replace(MARK, " ") for c in cuts]
        right = self.library.encode(plain, num_threads=1)
        if not self.spec.prefix or self.spec.squeeze:
            right = [r if p == c.replace(MARK, " ").strip(" ") else f for r, f, p, c in zip(right, found, plain, cuts, strict=True)]
        # A lone marker is the library's empty text, which it doesn't encode.
        return [r if p else f for r, f, p in zip(right, found, plain, strict=True)]

    def _add(self, cuts: list[str]) -> None:
        """Encode cuts by the backend, verify them and keep what they give."""
        found = self._backend_ids(cuts)
        for i, (own, right) in enumerate(zip(found, self._library_ids(cuts, found), strict=True)):
            if own != right:
                self.fallbacks += 1
                self.odd[cuts[i]] = "", False
                found[i] = right
        for cut, own, decoded in zip(cuts, found, self.bare.decode_batch(found, skip_special_tokens=False), strict=True):
            self.young[cut] = struct.pack(f"<{len(own)}I", *own)
            if cut in self.odd or decoded != cut.replace(MARK, " "):
                self.odd[cut] = decoded, cut not in self.odd

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str, bool]]:
        """For each text its ids as little-endian unsigned 32-bit numbers, what they decode to, and whether the backend gave them all."""
        normal = [self.normalised(t) for t in texts]
        split = [self._cut(x) for x in normal]
        missing = set().union(*split) - self.young.keys()
        if missing:
            again = missing & self.old.keys()
            self.young.update((c, self.old[c]) for c in again)
            self._add(list(missing - again))
        look, odd = self.young.__getitem__, self.odd
        out = []
        for text, cuts in zip(normal, split, strict=True):
            if odd.keys().isdisjoint(cuts):
                decoded, agree = text.replace(MARK, " "), True
            else:
                decoded = "".join([odd[c][0] if c in odd else c.replace(MARK, " ") for c in cuts])
                agree = all(odd[c][1] for c in cuts if c in odd)
            out.append((b"".join(map(look, cuts)), decoded[self.spec.prefix :], agree))
        for c in missing:
            if len(c) > LONGEST:
                del self.young[c]
                self.odd.pop(c, None)
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
            self.odd = {c: x for c, x in self.odd.items() if c in self.old}
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(ids, skip_special_tokens=False)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_crc32", pa.int64()), ("round_trip", pa.bool_()), ("parity", pa.bool_())])


def _coder(path: str):
    def run(batches):
        codec = Codec.of_worker(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            coded = codec.encode(texts)
            rows = [
                (len(b) // 4, zlib.crc32(b), zlib.crc32(d.encode()), d == codec.normalised(t).replace(MARK, " ")[codec.spec.prefix :], p)
                for t, (b, d, p) in zip(texts, coded, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows), _SCHEMA.types[1:], strict=True))], schema=_SCHEMA)

    return run


def round_trips(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_crc32, round_trip and parity for every row of ``docs``."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_coder(path), "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean, parity boolean")


def encoder(path: str):
    """A function of a text column that gives its ids as an array."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        found = Codec.of_worker(path).encode(texts.tolist())
        return pd.Series([list(struct.unpack(f"<{len(b) // 4}I", b)) for b, _, _ in found])

    return encode


def decoder(path: str):
    """A function of a column of ids that gives their text."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        return pd.Series(Codec.of_worker(path).decode([[] if x is None else list(x) for x in ids]))

    return decode
