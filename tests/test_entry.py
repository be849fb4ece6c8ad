import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
    assert out.returncode == 0, out.stderr
    found, sql = (x.split() for x in out.stdout.splitlines()[-2:])
    return found, sql


def test_the_library_stands_without_the_training_data_part(tmp_path):
    shutil.copytree(os.path.join(ROOT, "loomdex"), tmp_path / "loomdex", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    found, sql = names(tmp_path)
    assert "bm25_search" in found and not any(n.startswith("op") or n == "pipeline" for n in found) and set(sql) <= set(found)


def test_errors_inside_the_training_data_part_are_not_swallowed(tmp_path):
    shutil.copytree(os.path.join(ROOT, "loomdex"), tmp_path / "loomdex", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import something_that_is_not_there\n")
    with pytest.raises(AssertionError, match="something_that_is_not_there"):
        names(tmp_path)


def test_every_sql_has_its_query():
    found, sql = names(ROOT)
    assert set(sql) <= set(found) and len(found) == len(set(found))


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
