"""The driver's contract, with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
SAYS = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"


def says(folder: Path, code: str) -> list[str]:
    run = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


def test_without_the_training_data_operators(tmp_path):
    from latticeq.plans import registry

    for name in ("latticeq", "tests"):
        shutil.copytree(REPO / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    expected = [str(len(registry.QUERIES)), str(len(registry.SQL)), "False"]
    assert says(tmp_path, SAYS) == expected
    if (REPO / "corpus_pipeline.py").exists():  # the same where the pipeline's file is still there
        shutil.copy(REPO / "corpus_pipeline.py", tmp_path)
        assert says(tmp_path, SAYS) == expected


def test_every_sql_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
