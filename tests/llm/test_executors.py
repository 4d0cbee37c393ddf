"""Every query and the pipeline with a driver that knows the package and executors that do not."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
for name, query in entry.queries().items():
    if name == "pipeline" or name.startswith("op"):
        query(spark, {data!r}).write.format("noop").mode("overwrite").save()
        print("ran", name, flush=True)
"""


def test_executors_without_the_package(tmp_path, sf_dir):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    (tmp_path / "job.py").write_text(SCRIPT.format(root=root, data=sf_dir))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "job.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    ran = [line.split()[1] for line in done.stdout.splitlines() if line.startswith("ran ")]
    assert done.returncode == 0, done.stderr[-3000:]
    assert "pipeline" in ran and {int(n[2:].split("_")[0]) for n in ran if n.startswith("op")} == set(range(1, 14))
