"""Operator 10: quality rules with thresholds taken from the data, by DataFrame functions alone.

Each text gives whole-number statistics (``with_statistics``).  Rates of them, in thousandths, are
counted into sketches: for each language, source and rule the number of documents in each of 1001
equal bins, over the documents that pass the base rules.  Such sketches merge by adding counts, in
any order, and a quantile of one is off by no more than a thousandth.  From the sketch of a group
come the quantiles of each rule (``RULES``: a high percentile, for some a low one too) and the
median, and from these its fences

    high = q_high + max(SPREAD (q_high - median), LEAST_REACH)
    low  = q_low  - max(SPREAD (median - q_low),  LEAST_REACH)

in place of fixed cutoffs: a fence lies beyond the group's own tail by as much again as that tail is wide, so it
moves and widens with the group.  LEAST_REACH is twice the sketch's resolution, the only constant distance;
it decides where a group's tail is as narrow as that (a rate that is zero in nearly all its texts).
A group of fewer than LEAST such documents takes the merged sketch of its language, and a language of
fewer than LEAST the merged sketch of all.  The fences are joined to the documents, which are
dropped outside them.

Percentiles follow what a rule measures: symbols, marks and word lengths are alike in nearly all texts of a
group, so their tail starts at 90 %; repeated words and lines are rare but usual in clean texts, so
theirs starts at 98 %.

Statistics are written once and read twice (sketches, verdicts); the sketches are aggregated on the
map side, so a hot source costs a few thousand rows.  A five-word window is told apart
by its 64-bit hash within its text.

Defined results: a null text has no words and fails; so does any with fewer than 10; null languages
and sources are groups like others; a value that ties with a fence is within it, and rows of equal bins count
each; repeated rows count each; very long texts are scored whole, in memory of a few times their
size; extra columns, also with the names of statistics, pass through ``keep_good`` untouched; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 50
#: Fixed values of the base rules: fewest words, and the largest share of repeated words in percent.
FEWEST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
SYMBOLS, MARKS = "#*$%&|<>", "!"
_SPACE = " \t\n\x0b\f\r"
#: rule: (low percentile, high percentile).  Bins are thousandths; of the mean word length, 40ths of a character.
RULES = {"symbols": (None, 90), "marks": (None, 90), "repeats": (None, 98), "lines": (None, 98), "length": (10, 90)}
#: How far beyond a percentile its fence lies, as a multiple of the distance from the median, and in bins at least.
SPREAD, LEAST_REACH = 2, 2

def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once for a row and use it many times."""
    return F.transform(F.array(value), body).getItem(0)


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeated_words(words: Column, n: Column) -> Column:
    """Words that lie in a window which the text has twice or more, the first one included."""

    def spans(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def covered(p: Column) -> Column:
            same = lambda x, k: F.coalesce(x["h"] == F.get(p, k)["h"], F.lit(False))
            again = F.filter(p, lambda x, k: same(x, k - 1) | same(x, k + 1))
            starts = F.sort_array(F.transform(again, lambda x: x["i"]))
            own = lambda s: F.transform(s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW))))
            return _let(starts, lambda s: F.aggregate(own(s), F.lit(0), lambda acc, x: acc + x))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(pairs, covered))

    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))
    return F.when(n <= WINDOW, F.lit(0)).otherwise(_let(hashes, spans)).cast("long")


def with_statistics(docs: DataFrame, text: Column, name: str = "stats") -> DataFrame:
    """Add a struct of n_words, word_chars, n_symbols, n_marks, n_lines, n_dup_lines and n_repeat_words."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    trimmed = F.btrim(body, F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \t\n\x0b\f\r]+"))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    size = lambda x: F.octet_length(x)
    return docs.withColumn(
        name,
        F.struct(
            _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w, F.size(w)).alias("repeats"))).alias("words"),
            F.length(_without(body, _SPACE)).cast("long").alias("word_chars"),
            (size(body) - size(_without(body, SYMBOLS))).cast("long").alias("n_symbols"),
            (size(body) - size(_without(body, MARKS))).cast("long").alias("n_marks"),
            _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dups"))).alias("lines"),
        ),
    )


def _bins(s: str = "stats") -> list[Column]:
    """The bin, 0 to 1000, of each of RULES."""
    share = lambda a, b, by=1000: F.least(F.lit(1000), F.expr(f"({by} * {a}) div greatest({b}, 1)")).cast("int")
    chars, n = f"{s}.word_chars", f"{s}.words.n"
    return [share(f"{s}.n_symbols", chars), share(f"{s}.n_marks", chars), share(f"{s}.words.repeats", n), share(f"{s}.lines.dups", f"{s}.lines.n"), share(chars, n, 40)]


def _quantile(bins: Column, n: Column, percent: int) -> Column:
    """Smallest bin up to which ``percent`` of the counts lie; ``bins`` is sorted [(bin, n), ...]."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("bin"))

    def step(acc: Column, x: Column) -> Column:
        seen = acc["seen"] + x["n"]
        return F.struct(seen.alias("seen"), F.coalesce(acc["bin"], F.when(seen * 100 >= n * percent, x["bin"])).alias("bin"))

    return F.aggregate(bins, start, step)["bin"]


def base_failed(s: str = "stats") -> Column:
    n, repeats = F.col(f"{s}.words.n"), F.col(f"{s}.words.repeats")
    return (n < FEWEST_WORDS) | (100 * repeats > MOST_REPEATED * n)


def sketches(stats: DataFrame) -> DataFrame:
    """lang, source, rule, bin, n of the documents that pass the base rules: the sketch of each group, mergeable by sums of n."""
    rules = F.array(*(F.struct(F.lit(k).alias("rule"), b.alias("bin")) for k, b in enumerate(_bins())))
    passed = stats.filter(~base_failed()).select("lang", "source", F.explode(rules).alias("r"))
    return passed.groupBy("lang", "source", "r.rule", "r.bin").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source, and for each rule low (null: none) and high: a row per group, from its own sketch or a merged one."""

    def limits(keys: list[str]) -> DataFrame:
        merged = sketch.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n")) if keys != ["lang", "source"] else sketch
        per_rule = merged.groupBy(*keys, "rule").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("n"))
        at = lambda percent: _quantile(F.col("bins"), F.col("n"), percent)
        by_rule = lambda which: F.element_at(F.create_map(*(F.lit(x) for k, r in enumerate(RULES.values()) if r[which] for x in (k, r[which]))), F.col("rule"))
        per_rule = per_rule.select(*keys, "n", "rule", at(by_rule(0)).alias("bottom"), at(F.lit(50)).alias("middle"), at(by_rule(1)).alias("top"))
        low = F.col("bottom") - F.greatest(SPREAD * (F.col("middle") - F.col("bottom")), F.lit(LEAST_REACH))
        high = F.col("top") + F.greatest(SPREAD * (F.col("top") - F.col("middle")), F.lit(LEAST_REACH))
        per_rule = per_rule.select(*keys, "n", "rule", F.struct(F.when(F.col("bottom").isNotNull(), low).alias("low"), high.alias("high")).alias("fence"))
        return per_rule.groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("rule") == k, F.col("fence"))).alias(name) for k, name in enumerate(RULES)))

    own, tongue, every = limits(["lang", "source"]).alias("o"), limits(["lang"]).alias("t"), limits([]).alias("e")
    both = own.join(tongue, F.col("o.lang").eqNullSafe(F.col("t.lang")), "left").join(F.broadcast(every), F.lit(True), "left")  # one row
    pick = lambda c: F.when(F.col("o.n") >= LEAST, F.col(f"o.{c}")).when(F.col("t.n") >= LEAST, F.col(f"t.{c}")).otherwise(F.col(f"e.{c}"))
    sides = [pick(name)[side].cast("int").alias(f"{name}_{side}") for name in RULES for side in ("low", "high")]
    return both.select(F.col("o.lang").alias("lang"), F.col("o.source").alias("source"), *sides)


def judge(stats: DataFrame) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to rows of lang, source and stats, which must come from a table."""
    limits = common.materialise(fences(sketches(stats)), "fences").alias("f")  # written, so its size is known when the join is planned
    joined = stats.alias("s").join(limits, F.col("s.lang").eqNullSafe(F.col("f.lang")) & F.col("s.source").eqNullSafe(F.col("f.source")), "left")
    within = F.lit(True)
    for (name, (low, _)), b in zip(RULES.items(), _bins(), strict=True):
        within = within & (b <= F.col(f"f.{name}_high"))
        if low:
            within = within & (b >= F.col(f"f.{name}_low"))
    own = [F.col(f"s.`{c}`") for c in stats.columns]
    return joined.select(*own, base_failed().alias("base_failed"), (~base_failed() & F.coalesce(within, F.lit(False))).alias("kept"))


def quality_rules(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, the statistics, base_failed and kept for every row of ``docs``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("body"))
    stats = common.materialise(with_statistics(rows, F.col("body")).drop("body"), "statistics")
    s = F.col("stats")
    return judge(stats).select("doc_id", s["words"]["n"].alias("n_words"), s["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"), s["lines"]["dups"].alias("n_dup_lines"), s["words"]["repeats"].alias("n_repeat_words"), "base_failed", "kept")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{source}`").cast("string").alias("source"))
    whole = common.materialise(with_statistics(whole, F.col(f"row.`{text}`")), "rows-with-statistics")
    return judge(whole).filter("kept").select("row.*")
