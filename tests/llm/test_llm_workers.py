"""Every registered query of this folder where the executors have no copy of the package."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_queries_where_workers_lack_the_package(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {REPO!r})
from kinesift.session import get_spark
import __spark_entry__ as e
spark = get_spark(master="local[4]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4"}})
spark.sparkContext.setLogLevel("OFF")
for name, query in e.queries().items():
    if name == "pipeline" or (name.startswith("op") and name[2].isdigit()):
        print("done", name, query(spark, "/root/testdata/sf0.001").count(), flush=True)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1500)
    seen = {line.split()[1]: int(line.split()[2]) for line in done.stdout.splitlines() if line.startswith("done")}
    assert len(seen) == 14 and all(seen.values()), (seen, done.stderr[-3000:])
