import os
import shutil
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_llm_subpackage(tmp_path):
    for name in ("skein", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{TOP}/{name}") else shutil.copy)(f"{TOP}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "skein" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); import pkgutil, importlib, skein; [importlib.import_module(m.name) for m in pkgutil.walk_packages(skein.__path__, 'skein.')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
