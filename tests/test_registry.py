"""The registry of queries, with and without the text operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(*sorted(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, env={**os.environ, "PYTHONPATH": folder}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_registry_without_the_text_operators(tmp_path):
    copy = str(tmp_path / "copy")
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    whole = names(copy) if os.path.isdir(f"{copy}/pitframe/llm") else []
    for part in ("pitframe/llm", "tests/llm"):
        shutil.rmtree(f"{copy}/{part}", ignore_errors=True)
    rest = names(copy)  # the pipeline is there but cannot be imported
    assert "price_daily" in rest and "pipeline" not in rest and not any(n.startswith("op") and n[2].isdigit() for n in rest)
    if os.path.exists(f"{copy}/corpus_pipeline.py"):
        os.remove(f"{copy}/corpus_pipeline.py")
    assert names(copy) == rest
    assert not whole or {"pipeline", "op1_sentencepiece"} <= set(whole)
