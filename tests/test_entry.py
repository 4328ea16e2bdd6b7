import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_works_without_the_text_operators(tmp_path):
    for f in os.listdir(ROOT):
        if f.endswith(".py") and f != "corpus_pipeline.py":
            shutil.copy(os.path.join(ROOT, f), tmp_path / f)
    shutil.copytree(os.path.join(ROOT, "sensorloom"), tmp_path / "sensorloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""})
