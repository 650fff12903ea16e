"""The entry module in a process of its own."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_import_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q), set(o) - set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert not done.returncode, done.stderr[-2000:]


def test_import_without_the_text_operators(tmp_path):
    """The rest is whole where llm and the pipeline are absent."""
    (tmp_path / "touchline").mkdir()
    for p in (ROOT / "touchline").iterdir():
        if p.name != "llm":
            (tmp_path / "touchline" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') and k[2].isdigit() or k == 'pipeline']; e.oracle_sql()"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert not done.returncode, done.stderr[-2000:]


def test_workers_get_the_package(tmp_path):
    """From another folder, without the repository on the workers' path."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.queries()["elo_day_frozen"](spark, "/root/testdata/sf0.001").count() > 0
"""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert not done.returncode, done.stderr[-3000:]
