"""Pre-tokens of the word-level BPE tokenizer, and caches of what the library makes of them.

A pre-token is a piece of text that the tokenizer encodes on its own: nothing left or right of
it changes its ids.  Two exact splits are used:

* Texts within Latin-1 (no composition can occur there and lower case is the same for Python
  and the library): lower-case, then the tokenizer's own split pattern written out for that range.
* All other texts: runs without space, tab, line feed or carriage return.  The pattern drops white
  space and never matches across it, and normalisation neither composes nor folds over it.

The library encodes each pre-token as it stands, so ids are the library's in either case.
"""

from __future__ import annotations

import os
import re

from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

#: Longer pre-tokens are encoded but not kept.
LONGEST = 64
#: Entries of each generation of a worker's cache.
CACHE = 196_608

#: The tokenizer's split pattern, its classes of letters and numbers written out for U+0000 to U+00FF.
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\t-\\r \\x85\\xa0{_LETTERS}{_NUMBERS}]+")


def _latin1(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _plain(text: str) -> bool:
    """Whether the first split holds: Latin-1 throughout, and no special token."""
    return "<|" not in text and _latin1(text)


def pretokens(text: str | None) -> list[str]:
    """The pre-tokens of ``text`` in order; a null text has none.  Special tokens stay in one piece."""
    if not text:
        return []
    if _plain(text):
        return _LATIN.findall(text.lower())
    return [x for x in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if x]


class PretokenEncoder:
    """Looks pre-tokens up in a first tier (shared, read only: ``lookup`` gives what it has), then in this worker's own cache.

    ``value(ids)`` is what is kept of a pre-token, and ``kind`` names it: the worker's cache is kept
    from task to task by tokenizer and kind.  The cache has two generations of at most CACHE entries
    and one batch: when the younger is full, the older goes, and what is still in use moves up.
    """

    #: By path: the tokenizer, and one without the steps that the first split has already taken.
    _tokenizers: dict[str, tuple[Tokenizer, Tokenizer]] = {}
    _caches: dict[tuple[str, str], list[dict]] = {}

    def __init__(self, path: str, kind: str, value, first=None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # executors run a task on each core already
        if path not in self._tokenizers:
            whole = Tokenizer.from_file(path)
            bare = Tokenizer(whole.model)
            bare.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
            self._tokenizers[path] = whole, bare
        (self.whole, self.bare), self.value, self.first = self._tokenizers[path], value, first
        self.generations = self._caches.setdefault((path, kind), [{}, {}])

    def encode(self, words: list[str], bare: bool = False):
        tokenizer = self.bare if bare else self.whole
        return map(self.value, (e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)))

    def values(self, texts: list[str | None]) -> list[list]:
        """For each text the values of its pre-tokens; what no tier has is encoded in one batch."""
        split = [pretokens(x) for x in texts]
        plain = [not x or _plain(x) for x in texts]
        words = set().union(*split)
        known = self.first.lookup(list(words)) if self.first else {}
        words.difference_update(known)
        young, old = self.generations
        missed = words
        words = words - young.keys()
        if words:
            again = words & old.keys()
            young.update((x, old[x]) for x in again)
            fresh = words - again
            if not all(plain):
                rest = fresh.intersection(set().union(*(x for x, p in zip(split, plain, strict=True) if not p)))
                fresh = fresh - rest
                rest = list(rest)
                young.update(zip(rest, self.encode(rest), strict=True))
            fresh = list(fresh)
            young.update(zip(fresh, self.encode(fresh, bare=True), strict=True))
        if known:
            known.update((w, young[w]) for w in missed)
        look = (known or young).__getitem__
        out = [list(map(look, x)) for x in split]
        for x in words:
            if len(x) > LONGEST:
                del young[x]
        if len(young) > CACHE:
            self.generations[:] = [{}, young]
        return out
