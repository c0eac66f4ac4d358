"""The entry works without the corpus operators, and hides no other import error."""

import os
import shutil
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), 'pipeline' in q, any(x.startswith('op1_') for x in q))"


def say(folder):
    return subprocess.run([sys.executable, "-B", "-c", SAY], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""}, timeout=120)


@pytest.fixture
def bare(tmp_path):
    """A copy of the repository without the corpus operators."""
    shutil.copytree(os.path.join(TOP, "quadlake"), tmp_path / "quadlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(TOP, name)):
            shutil.copy(os.path.join(TOP, name), tmp_path)
    return tmp_path


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_corpus_operators(bare, pipeline):
    if not pipeline:
        (bare / "corpus_pipeline.py").unlink(missing_ok=True)
    got = say(bare)
    assert got.returncode == 0, got.stderr
    n, sqls, has_pipeline, has_ops = got.stdout.split()
    assert int(n) > 100 and int(sqls) > 100 and (has_pipeline, has_ops) == ("False", "False")


def test_other_import_errors_are_told(bare):
    (bare / "quadlake" / "llm").mkdir()
    (bare / "quadlake" / "llm" / "__init__.py").write_text("")
    (bare / "quadlake" / "llm" / "queries.py").write_text("import a_module_that_is_not_there")
    got = say(bare)
    assert got.returncode and "a_module_that_is_not_there" in got.stderr
