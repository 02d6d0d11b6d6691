"""The driver's contract, and that nothing outside the training-data folder needs it."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def without_root(folder):
    """The environment of a child that sees ``folder`` and what this process can import, but for this repository."""
    rest = [p for p in sys.path if p and os.path.abspath(p) != ROOT]
    return os.environ | {"PYTHONPATH": os.pathsep.join([str(folder), *rest])}


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_works_without_the_training_data_folder(tmp_path):
    for name in ("specaudit", "__spark_entry__.py"):
        at = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(at) else shutil.copy)(at, tmp_path / name)
    shutil.rmtree(tmp_path / "specaudit" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=without_root(tmp_path))


def test_rest_of_the_tests_does_not_need_the_training_data_folder(tmp_path):
    for name in ("specaudit", "tests"):
        shutil.copytree(os.path.join(ROOT, name), tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(os.path.join(ROOT, name), tmp_path / name)
    got = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "-p", "no:cacheprovider", "tests"], cwd=tmp_path, env=without_root(tmp_path), capture_output=True, text=True)
    assert got.returncode == 0 and "test_query_equals_sql" in got.stdout, got.stdout[-2000:]


def test_entry_without_an_optional_library(tmp_path):
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join([ROOT, *sys.path])})
