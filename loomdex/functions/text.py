"""Text normalisation as Column expressions: everything here stays inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE_MAX, SNIPPET_MAX = 120, 300
#: The entities that are decoded by name.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
ENTITY = r"&(?:#x[0-9a-fA-F]+|#[0-9]+|" + "|".join(ENTITIES) + ");"
#: File extensions that count as text.
TEXT_EXTENSIONS = (".md", ".mdx", ".txt", ".html", ".htm", ".json", ".yaml", ".yml")
FILE_MAX = 1024 * 1024
#: Where a root keeps what is derived from it.
STATE_FOLDER = ".loomdex"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def as_lines(text: Column) -> Column:
    """Lines of any line ending; a trailing end gives an empty last line."""
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "")


def fold_space(text: Column) -> Column:
    return F.regexp_replace(text, "[ \t]+", " ")


def _entity(e: Column) -> Column:
    body = F.substring(e, 2, 1 << 20)
    digits = lambda pattern: F.regexp_extract(body, pattern, 1)
    # More than eight digits after leading zeros are beyond the last code point in any case.
    value = lambda d, base: F.when(F.length(d) > 8, F.lit(0x110000)).otherwise(F.conv(F.concat(F.lit("0"), d), base, 10).cast("long"))
    n = F.when(body.startswith("#x"), value(digits("^#x0*([0-9a-fA-F]*);"), 16)).when(body.startswith("#"), value(digits("^#0*([0-9]*);"), 10))
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    out = F.when(n.isNotNull() & (n <= 0x10FFFF), char).when(n.isNotNull(), e)
    for name, value in ENTITIES.items():
        out = out.when(e == f"&{name};", F.lit(value))
    return out


def decode_entities(text: Column) -> Column:
    """One pass over named and numeric entities, so what decoding makes is never decoded again."""
    parts, found = F.split(text, ENTITY, -1), F.regexp_extract_all(text, F.lit(ENTITY), 0)
    joined = F.array_join(F.zip_with(parts, found, lambda p, e: F.concat(p, F.coalesce(_entity(e), F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def note_lines(text: Column) -> Column:
    """Lines without a leading byte order mark, entities decoded in each."""
    return F.transform(as_lines(strip_bom(text)), decode_entities)


def note_title(text: Column) -> Column:
    """The first heading of one to six signs outside fenced code, at most 120 characters; else null."""
    state = F.struct(F.lit("").alias("fence"), F.lit(None).cast("string").alias("title"))

    def step(acc: Column, line: Column) -> Column:
        t = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
        mark = F.regexp_extract(t, "^(```|~~~)", 1)
        fence = F.when(mark == "", acc["fence"]).when(acc["fence"] == "", mark).when(acc["fence"] == mark, F.lit("")).otherwise(acc["fence"])
        heading = F.regexp_extract(t, r"^#{1,6}\s+(\S.*)$", 1)
        title = F.coalesce(acc["title"], F.when((mark == "") & (acc["fence"] == "") & (heading != ""), F.substring(F.rtrim(heading), 1, TITLE_MAX)))
        return F.struct(fence.alias("fence"), title.alias("title"))

    body = strip_bom(text)
    return F.when(F.contains(body, F.lit("#")), F.aggregate(as_lines(body), state, step)["title"])


def stem(path: Column) -> Column:
    """The file name without folders and its last extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def choose_title(mapped: Column, text: Column, path: Column) -> Column:
    """A mapped title, else the note's own, else the file's stem."""
    return F.substring(F.coalesce(mapped, note_title(text), stem(path)), 1, TITLE_MAX)


def source_title(text: Column, path: Column) -> Column:
    """The first level-one heading anywhere, fences or not; else the stem."""
    found = F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1))
    return F.when(found != "", F.substring(found, 1, TITLE_MAX)).otherwise(stem(path))


def clip_around(line: Column, needle: Column, size: int = SNIPPET_MAX) -> Column:
    """At most ``size`` characters with the needle a third in; an ellipsis stands for each cut edge."""
    at = F.greatest(F.call_function("locate", F.lower(needle), F.lower(line)), F.lit(1)) - 1
    start = F.greatest(F.lit(0), at - size // 3)
    cut = F.substring(line, start + 1, F.lit(size))
    cut = F.when(start > 0, F.concat(F.lit("…"), F.substring(cut, F.lit(2), F.lit(size)))).otherwise(cut)
    cut = F.when(start + size < F.length(line), F.concat(F.substring(cut, F.lit(1), F.length(cut) - 1), F.lit("…"))).otherwise(cut)
    return F.when(F.length(line) <= size, line).otherwise(cut)


def is_text_file(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*TEXT_EXTENSIONS)


def skip_reason(content: Column) -> Column:
    """Why bytes aren't read as text: too-large, binary, non-utf8; null if they are."""
    return (
        F.when(F.octet_length(content) > FILE_MAX, F.lit("too-large"))
        .when(F.call_function("locate", F.unhex(F.lit("00")), content) > 0, F.lit("binary"))
        .when(~F.is_valid_utf8(content), F.lit("non-utf8"))
    )


def in_folder(path: Column, folder: Column) -> Column:
    """Whether ``path`` is the folder or lies in it; a sibling with the same beginning doesn't count."""
    return (path == folder) | path.startswith(F.concat(folder, F.lit("/")))


def clean_relative(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", "")


def excluded(path: Column, rules: Column) -> Column:
    """Whether a path-segment prefix of ``path`` is among ``rules`` (an array); not a glob."""
    p = clean_relative(path)
    clean = lambda r: F.regexp_replace(clean_relative(r), "/+$", "")
    return F.exists(F.coalesce(rules, F.array().cast("array<string>")), lambda r: (clean(r) != "") & in_folder(p, clean(r)))


def is_ai_note(path: Column) -> Column:
    return clean_relative(path).rlike("^(digests|lessons)(/|$)")


def is_managed(path: Column, state_folder: str = STATE_FOLDER) -> Column:
    return clean_relative(path).rlike(f"^(digests|lessons|{re.escape(state_folder)})(/|$)")


def is_original_text_file(path: Column, state_folder: str = STATE_FOLDER) -> Column:
    """A text file that is neither a note of ours nor derived from one."""
    return is_text_file(path) & ~is_managed(path, state_folder)


#: What the end of a partly read file says.
READ_FOOTER = r"\[Showing lines |more lines in file\. Use offset="


def is_truncated_read(text: Column, offset: Column | None = None, flagged: Column | None = None) -> Column:
    """Whether a tool's reading of a file isn't the whole file: it says so, began after line 1, or ends in a footer."""
    out = text.rlike(READ_FOOTER)
    if offset is not None:
        out = F.coalesce(offset > 1, F.lit(False)) | out
    return out if flagged is None else F.coalesce(flagged, F.lit(False)) | out


#: Secrets by kind in the order in which they are looked for.
SECRETS = {
    "private-key": r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----",
    "github-token": r"\b(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{20,}\b",
    "api-token": r"\bsk-[A-Za-z0-9]{20,}\b",
    "slack-token": r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b",
    "aws-key": r"\bAKIA[0-9A-Z]{16}\b",
}
#: What labels a secret, and values that stand for none.
LABELED = r"""(?i)\b(?:password|passwd|secret|api[_-]?key|access[_-]?key)\s*[:=]\s*["']?([^\s"'#]+)"""
PLACEHOLDER = r"(?i)^(your[_-]?.*|xxx+|placeholder|example|changeme|<[^>]+>|\$\{.*\})$"


def secret_kind(text: Column) -> Column:
    """The first kind of secret that stands in the text; of labelled values only the first is looked at."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, pattern in SECRETS.items():
        out = out.when(text.rlike(pattern), F.lit(kind))
    value = F.regexp_extract(text, LABELED, 1)
    return out.when((F.length(value) >= 8) & ~value.rlike(PLACEHOLDER), F.lit("labeled-secret"))


def doc_key(source: Column, path: Column) -> Column:
    """A document's id: 32 hex digits from its source's key and its relative path."""
    return F.substring(F.sha2(F.concat(source, F.lit("\n"), clean_relative(path)), 256), 1, 32)


def bucket_of(value: Column, buckets: int = 256) -> Column:
    """The first eight hex digits of the value's sha256, as a number modulo ``buckets``."""
    return F.pmod(F.conv(F.substring(F.sha2(value, 256), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def read_reference(text: Column) -> Column:
    """A UUID that stands in the text, else the text without quotes around it."""
    uuid = F.regexp_extract(text, "(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", 0)
    return F.when(uuid != "", F.lower(uuid)).otherwise(F.regexp_replace(F.trim(text), "^[\"'`]+|[\"'`]+$", ""))
