"""The driver contract holds without the corpus operators."""

import os
import shutil
import subprocess
import sys

from tests.conftest import ROOT


def test_entry_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'condition_aware_cv' in q and 'pipeline' not in q; " \
           "assert not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_no_module_of_the_library_imports_the_corpus_operators():
    for folder, names, files in os.walk(os.path.join(ROOT, "condfuse")):
        names[:] = [n for n in names if n not in ("llm", "__pycache__")]
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f), encoding="utf-8") as text:
                    assert "condfuse.llm" not in text.read(), f
