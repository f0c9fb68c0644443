"""Python workers must not need the package on their path."""

import os
import subprocess
import sys

from gridloom.sources import workspace

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
import __spark_entry__ as entry
for name in ("o_h6_ssim", "o_h3_predict"):
    print(name, entry.queries()[name](spark, {sf!r}).count() > 0)
"""


def test_queries_with_python_run_from_any_folder(sf, tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo, sf=sf)],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False,
    )
    assert "o_h6_ssim True" in done.stdout and "o_h3_predict True" in done.stdout, done.stderr[-2000:]


def test_own_working_folder_can_be_forgotten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workspace, "work_dir", lambda _: str(tmp_path / "run"))
    assert workspace.cut(spark.range(5), "five").count() == 5 and list((tmp_path / "run").iterdir())
    workspace.forget(spark)
    assert not (tmp_path / "run").exists()
