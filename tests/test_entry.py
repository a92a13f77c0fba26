"""The entry module without the optional corpus operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry
from idweft.plans.queries import QUERIES

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_entry_without_the_corpus_operators(tmp_path):
    for name in ("idweft", "__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            (shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy)(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "idweft" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    queries, oracles = said.stdout.splitlines()[-2:]
    assert queries.split() == sorted(QUERIES) and set(oracles.split()) <= set(queries.split())


def test_entry_without_a_library_of_the_corpus_operators():
    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; print(*sorted(e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")}, capture_output=True, text=True, check=True)
    assert said.stdout.splitlines()[-1].split() == sorted(QUERIES)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
