"""The library without its training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
LOOK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), sorted(set(s) - set(q)), any(n.startswith('op1_') or n == 'pipeline' for n in q))"


def copy(tmp_path):
    for part in ("larkspur", "__spark_entry__.py", "corpus_pipeline.py"):
        at = ROOT / part
        if at.is_dir():
            shutil.copytree(at, tmp_path / part, ignore=shutil.ignore_patterns("__pycache__"))
        elif at.exists():
            shutil.copy(at, tmp_path / part)


def look(tmp_path):
    out = subprocess.run([sys.executable, "-B", "-c", LOOK], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n, rest = out.stdout.split(maxsplit=1)
    return int(n), rest.strip()


def test_the_rest_imports_without_the_subpackage(tmp_path):
    copy(tmp_path)
    shutil.rmtree(tmp_path / "larkspur" / "llm", ignore_errors=True)
    n, rest = look(tmp_path)  # the pipeline's file may still be there
    assert n > 100 and rest == "[] False"
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert look(tmp_path) == (n, rest)


def test_nothing_else_imports_the_subpackage():
    for f in [*(ROOT / "larkspur").rglob("*.py")]:
        if "llm" not in f.relative_to(ROOT / "larkspur").parts:
            assert ".llm" not in f.read_text() and "larkspur.llm" not in f.read_text(), f
