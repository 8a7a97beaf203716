"""A stock installation, without a configuration of Spark, runs what stages tables."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
RUN = """
from kvasir.plans import registry
from kvasir.session import local_session, shared_dir

spark = local_session(2, 2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_dir(spark) == shared_dir(spark) and shared_dir(spark).startswith("file:")
print("ROWS", registry.queries()["traverse_graph"](spark, "/root/testdata/sf0.001").count())
"""


def test_staged_tables_need_no_setting(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT), "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", RUN], env=env, capture_output=True, text=True, timeout=300, cwd=ROOT)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
