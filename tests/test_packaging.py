"""Workers import the package wherever the driver was started."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = f"""
import sys; sys.path.insert(0, {ROOT!r})
from panelspark.session import local_session
spark = local_session(2)
import __spark_entry__ as e
print("ROWS", e.queries()["b21_equal_risk_book"](spark, "/root/testdata/sf0.001").count())
"""


def test_grouped_python_runs_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
