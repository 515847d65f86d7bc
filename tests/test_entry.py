"""The driver's entry with and without the subpackage for training text."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(block: str) -> set[str]:
    code = f"import sys; {block}; import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=REPO, capture_output=True, text=True, check=True, timeout=300)
    return set(done.stdout.split())


def test_entry_without_the_subpackage():
    left = names("sys.modules['questloom.llm'] = None; sys.modules['corpus_pipeline'] = None")
    assert "v1_knn" in left and not any(n.startswith("op") for n in left)


def test_entry_lists_what_is_there():
    assert "v1_knn" in names("pass")
