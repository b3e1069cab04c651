"""The registry works without the corpus-preparation part."""
import shutil
import subprocess
import sys
from pathlib import Path


def test_registry_without_the_corpus_part(tmp_path):
    top = Path(__file__).resolve().parents[1]
    shutil.copytree(top, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = ("import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); "
            "assert len(q) > 80 and set(s) <= set(q) and not [k for k in q if k[:2] == 'op' or k == 'pipeline'], q.keys()")
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True)
        (tmp_path / "repo" / "corpus_pipeline.py").unlink(missing_ok=True)
