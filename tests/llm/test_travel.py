"""Python workers need neither the package nor the vocabulary on their own paths."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.executor.memory", "900m").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
for name in ("p3_found", "p4_found", "p6_found", "p7_fill", "p8_shares", "p9_found"):
    print("ROWS", name, entry.queries()[name](spark, {sf!r}).count())
"""


def test_queries_run_from_another_folder(sf, tmp_path):
    vocabulary = tmp_path / "own.tiktoken"
    shutil.copy("/opt/tokenizers/byte_bpe_multi_50k.tiktoken", vocabulary)
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH",)} | {"QUERENT_VOCABULARY": str(vocabulary), "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_WORKER_DIR": str(tmp_path / "work")}
    script = SCRIPT.format(repo=str(REPO), shared=f"file://{tmp_path}/shared", sf=sf)
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    rows = {line.split()[1]: int(line.split()[2]) for line in done.stdout.splitlines() if line.startswith("ROWS")}
    assert len(rows) == 6 and all(rows.values()), done.stderr[-3000:]
