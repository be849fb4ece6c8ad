"""Search terms: runs of CJK characters and identifiers, with grams and parts.

The Column form builds postings; the Python form (same rules) only serves the few words of a query.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: The characters of runs, where identifiers have parts, and the longest query.
CJK = "㐀-鿿豈-﫿"
RUN = f"[{CJK}]+|[A-Za-z0-9_][A-Za-z0-9_.]*"
COMPOUND = "[._]|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"
QUERY_MAX = 512
#: Fixed values, the boundaries above written as what occurs at them: a text without these has neither CJK runs nor identifiers with parts: its runs are its terms.
SPECIAL = f"[{CJK}_]|[A-Za-z0-9]\\.[A-Za-z0-9.]|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"


def _cjk_terms(run: Column) -> Column:
    n = F.length(run)
    chars = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, F.lit(1)))
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(run, i, F.lit(2)))
    return F.when(n > 1, F.concat(chars, pairs)).otherwise(chars)


def camel_parts(piece: Column) -> Column:
    """Lower-case parts at changes of case, without the piece as a whole."""
    spaced = F.regexp_replace(F.regexp_replace(piece, "([a-z0-9])(?=[A-Z])", "$1 "), "([A-Z])(?=[A-Z][a-z])", "$1 ")
    return F.filter(F.split(F.lower(spaced), " "), lambda c: (c != "") & (c != F.lower(piece)))


def _identifier_terms(run: Column) -> Column:
    def parts(full: Column) -> Column:
        pieces = F.filter(F.split(run, "[._]"), lambda p: p != "")

        def of(p: Column) -> Column:
            own = F.when(F.lower(p) != full, F.array(F.lower(p))).otherwise(F.array().cast("array<string>"))
            return F.concat(own, F.filter(camel_parts(p), lambda c: c != full))

        return F.concat(F.array(full), F.flatten(F.transform(pieces, of)))

    return F.when(run.rlike(COMPOUND), let(F.lower(run), parts)).otherwise(F.array(F.lower(run)))


def terms(text: Column) -> Column:
    """Every emission of a term in ``text``, repeats included: their number is the term frequency."""
    plain = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), 0), F.lower)
    runs = F.transform(F.regexp_extract_all(text, F.lit(RUN), 0), lambda r: F.when(r.endswith("."), F.substring(r, F.lit(1), F.length(r) - 1)).otherwise(r))
    whole = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]"), _cjk_terms(r)).otherwise(_identifier_terms(r))))
    return F.when(text.rlike(SPECIAL), whole).otherwise(plain)


#: The same changes of case as places between characters.
_SPLIT_CAMEL = re.compile("(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def query_tokens(text: str) -> list[str]:
    """The same terms for a query's words, in Python."""
    out: list[str] = []
    for run in re.findall(RUN, text):
        if re.match(f"[{CJK}]", run):
            out += [*run, *(run[i : i + 2] for i in range(len(run) - 1))]
            continue
        run = run[:-1] if run.endswith(".") else run
        full = run.lower()
        out.append(full)
        for piece in filter(None, re.split("[._]", run)):
            low = piece.lower()
            out += [low] * (low != full)
            out += [c for c in (x.lower() for x in _SPLIT_CAMEL.split(piece)) if c and c not in (full, low)]
    return out


def parse_query(query: str) -> tuple[list[str], list[str]]:
    """(groups, phrases): quoted stretches are phrases, the rest is cut at white space."""
    phrases = [p.strip() for p in re.findall('"([^"]+)"', query) if p.strip()]
    return re.sub('"[^"]+"', " ", query).split(), phrases


def needles(group: str) -> list[str]:
    """Distinct terms of a group; single characters only if there is nothing longer."""
    found = list(dict.fromkeys(query_tokens(group)))
    return [t for t in found if len(t) > 1] or found


def query_terms(query: str) -> list[str]:
    """The words of a scan; raises for an empty or overlong query."""
    if len(query) > QUERY_MAX:
        raise ValueError(f"the query is longer than {QUERY_MAX} characters")
    if not query.split():
        raise ValueError("the query is empty")
    return query.split()
