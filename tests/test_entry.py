"""The entry point works with and without the subpackage for training corpora."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_llm(tmp_path):
    """Everything but the two folders: all modules and the other tests can be imported."""
    for p in (ROOT).iterdir():
        if p.name in ("tidemark", "tests"):
            (tmp_path / p.name).mkdir()
            for q in p.iterdir():
                if q.name not in ("llm", "__pycache__"):
                    (tmp_path / p.name / q.name).symlink_to(q)
        elif p.suffix == ".py":
            (tmp_path / p.name).symlink_to(p)
    assert (tmp_path / "corpus_pipeline.py").exists()
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; n = e.queries(); assert 'candle_stick' in n and not any(x.startswith('op1_') for x in n) and 'pipeline' not in n and set(e.oracle_sql()) <= set(n)"
    env = {"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYTHONPATH": ""}
    subprocess.run([sys.executable, "-B", "-c", code], check=True, cwd=tmp_path, env=env)
    subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", "--collect-only", "-p", "no:cacheprovider", "tests"], check=True, cwd=tmp_path, env=env)
