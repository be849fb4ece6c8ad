"""Small rows with the edge cases that every operator must stand."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("score", "row", "at", "fp", "length", "stats", "kept", "words")]
)

PROSE = "The quick brown fox jumps over the lazy dog while seven wizards boil a pot of tea near the old mill. "


def rows():
    long = " ".join(f"word{i}" for i in range(6000))
    texts = [None, "", " \n\t ", "a", "one two three", PROSE * 3, PROSE * 3, PROSE.upper() + "x", "é̂ Å ﬁ İI Σας 漢字かな", "tab\tsep\x0bvt\x0cff\xa0nbsp\x1fus", long, "### $$$ %%% " * 30, "<|endoftext|> inside <|startoftext|>", "😀 astral 𝒳 chars", PROSE * 3, "don't we'll they're I'm", "7 ² ½ ٣ digits 12345"]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    out += [(5, PROSE * 3, "en", "s1", 1), (None, PROSE * 3, "en", "s1", 1), (None, None, None, None, None), (1001, "une phrase en français, déjà écrite", "fr", "s0", 3)]
    return [(*r, *["clash"] * 8) for r in out]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
