"""Registered queries that read every character and every chunk of long documents."""

import pytest

from loomdex.plans import queries


def test_secrets_deep_in_long_texts_are_found(spark, tmp_path):
    filler = "plain words without anything to hide\n" * 2000
    secrets = ["-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 12, "sk-" + "Ab3" * 8, "xoxb-" + "12-ab" * 5, "AKIA" + "ABCD1234" * 2, "api_key = 'qwertyuiop'"]
    kinds = ["private-key", "github-token", "api-token", "slack-token", "aws-key", "labeled-secret"]
    rows = [(6 + 9 * i, filler + s + "\n" + filler) for i, s in enumerate(secrets)] + [(600, filler), (9, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.kind for r in queries.secret_kinds(spark, str(tmp_path)).collect()}
    assert got == {6 + 9 * i: k for i, k in enumerate(kinds)} | {600: None, 9: "private-key"}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_texts_agree_with_the_sql_of_secret_kinds(spark, sf):
    kinds = ["private-key", "github-token", "api-token", "slack-token", "aws-key", "labeled-secret", None, None, None]
    rows = queries.secret_kinds(spark, f"/root/testdata/{sf}").collect()
    assert rows and all(r.kind == kinds[r.doc_id % 9] for r in rows)


def brute_chunks(text):
    """(idx, start_line, end_line, first line) by 12,000 characters; for texts without headings, fences or tables."""
    lines, out, start, chars = text.split("\n"), [], 0, 0
    for k, line in enumerate(lines):
        if k > start and chars + len(line) + 1 > 12_000:
            out.append((start, k))
            start, chars = k, 0
        chars += len(line) + 1
    out.append((start, len(lines)))
    return [(i, a + 1, b, lines[a].strip(" ")[:60]) for i, (a, b) in enumerate(out)]


def test_every_chunk_of_every_document_is_enriched(spark, tmp_path):
    texts = {1: "short\ntext", 2: "\n".join(f" line {k} " + "x" * (k % 300) for k in range(400)), 3: "head\n" + "y" * 13_000 + "\ntail", 4: "z" * 12_000, 5: "no size"}
    rows = [(i, t, None if i == 5 else len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.idx, r.start_line, r.end_line, r.summary) for r in queries.QUERIES["enrichment"](spark, str(tmp_path)).filter("status = 'completed'").collect())
    want = [(i, *c) for i, t in texts.items() for c in brute_chunks(t)]
    assert got == want and len([w for w in want if w[0] == 2]) > 3
