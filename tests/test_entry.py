import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_and_sql_need_no_session():
    """In a process of its own, as other tests have a session."""
    code = "import __spark_entry__ as e; from pyspark import SparkContext; q = e.queries(); assert set(e.oracle_sql()) <= set(q); assert SparkContext._active_spark_context is None; print(*q)"
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    names = run.stdout.split()
    assert {"pipeline", "sm_09_occupancy_stream"} <= set(names) and {n.split("_")[0] for n in names} >= {f"op{i}" for i in range(1, 11)}
