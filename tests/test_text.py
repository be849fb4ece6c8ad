import html
import re

import pytest
from pyspark.sql import functions as F

from loomdex.functions import text as tx
from loomdex.functions import tokens


def column(spark, values, f, schema="x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_lines(spark):
    assert column(spark, ["a\r\nb\rc\n", "", None], tx.as_lines) == [["a", "b", "c", ""], [""], None]
    assert column(spark, ["﻿a", "﻿﻿a", "a﻿"], tx.strip_bom) == ["a", "﻿a", "a﻿"]
    assert column(spark, ["a \t b\n  c"], tx.fold_space) == ["a b\n c"]


def decode(t):
    named = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}

    def one(m):
        e = m[1]
        if e in named:
            return named[e]
        n = int(e[2:], 16) if e.startswith("#x") else int(e[1:])
        return chr(n) if n <= 0x10FFFF else m[0]

    return re.sub("&(#x[0-9a-fA-F]+|#[0-9]+|amp|lt|gt|quot|apos|nbsp);", one, t)


def test_entities_are_decoded_once(spark):
    cases = ["&amp;lt;", "&#38;lt;", "&#x26;#60;", "a&nbsp;b &apos;&quot;", "&#128512;&#x1F600;", "&#1114112; &#99999999999999999999999; &#x110000;", "&#X41;", "&copy;&", "&#00000000065;", "x&lt;y&gt;", "", "&#65;&#66;"]
    assert column(spark, cases, tx.decode_entities) == [decode(c) for c in cases]
    assert html.unescape("&lt;") == decode("&lt;")


def test_titles(spark):
    cases = ["```\n# no\n```\n## Yes  ", "~~~\n```\n~~~\n# A", "#no\n# " + "x" * 200, "plain", "   ###### deep\n", "```\n# never"]
    assert column(spark, cases, tx.note_title) == ["Yes", "A", "x" * 120, None, "deep", None]
    assert column(spark, ["a/b.c.md", "noext", ".hidden", "d.e/x"], tx.stem) == ["b.c", "noext", ".hidden", "x"]
    assert column(spark, ["```\n# in\n```", "none"], lambda c: tx.source_title(c, F.lit("p/n.md"))) == ["in", "n"]


def test_clip(spark):
    line = "a" * 200 + "NEEDLE" + "b" * 400
    (out,) = column(spark, [line], lambda c: tx.clip_around(c, F.lit("needle")))
    want = line[100:400]
    assert out == "…" + want[1:-1] + "…" and len(out) == 300
    assert column(spark, ["short", line], lambda c: tx.clip_around(c, F.lit("zz")))[1] == line[:299] + "…"


def test_paths(spark):
    rules = F.array(F.lit("a/b/"), F.lit("\\c"), F.lit(""))
    assert column(spark, ["a/b", "a/b/x", "a/bc", "/c/d", "\\c\\d", "e"], lambda c: tx.excluded(c, rules)) == [True, True, False, True, True, False]
    assert column(spark, ["digests/x", "lessons", ".loomdex/x", "digestsx", "a/digests"], tx.is_managed) == [True, True, True, False, False]
    assert column(spark, ["a.MD", "b.mdx", "c.png", "d", "e.f/g"], tx.is_text_file) == [True, True, False, False, False]


@pytest.mark.parametrize(
    "text, kind",
    [
        ("-----BEGIN OPENSSH PRIVATE KEY-----", "private-key"),
        ("x ghp_" + "a" * 20, "github-token"),
        ("sk-" + "a" * 20, "api-token"),
        ("xoxb-" + "1" * 20, "slack-token"),
        ("AKIA" + "A" * 16, "aws-key"),
        ("Password = 'hunter2hunter2'", "labeled-secret"),
        ("password: your_password_here", None),
        ("api-key=<put it here>", None),
        ("secret: short then password: longenough1", None),
        ("nothing", None),
    ],
)
def test_secrets(spark, text, kind):
    assert column(spark, [text], tx.secret_kind) == [kind]


def test_skip_reasons(spark):
    cases = [b"ok", b"a\0b", b"\xff\xfe", b"x" * (1024 * 1024 + 1)]
    assert column(spark, [bytearray(c) for c in cases], tx.skip_reason, "x binary") == [None, "binary", "non-utf8", "too-large"]


TERMS = {
    "离职标记": ["离", "职", "标", "记", "离职", "职标", "标记"],
    "headerField": ["headerfield", "header", "field"],
    "observed.FullName": ["observed.fullname", "observed", "fullname", "full", "name"],
    "HTTPServer2Go.": ["httpserver2go", "http", "server2", "go"],
    "a_b": ["a_b", "a", "b"],
    "réaux": ["r", "aux"],
    "constructor": ["constructor"],
    "x 中y": ["x", "中", "y"],
    "foo..": ["foo.", "foo"],
}


def test_terms_in_both_forms(spark):
    assert column(spark, list(TERMS), tokens.terms) == list(TERMS.values())
    for text, want in TERMS.items():
        assert tokens.query_tokens(text) == want


def test_queries():
    assert tokens.parse_query('a "b c" d " "') == (["a", "d"], ["b c"])
    assert tokens.needles("员工") == ["员工"] and tokens.needles("员") == ["员"]
    for bad in ("", "x" * 513):
        with pytest.raises(ValueError):
            tokens.query_terms(bad)


def test_ids(spark):
    assert column(spark, ["离职"], tx.bucket_of) == [187]
    uuid = "12345678-1234-1234-1234-1234567890AB"
    assert column(spark, [f"readRef = {uuid}", "'x/y.md'"], tx.read_reference) == [uuid.lower(), "x/y.md"]
