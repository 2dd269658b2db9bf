"""Workers that do not see the package: what a task needs travels with the job."""

import os
import subprocess
import sys

import pytest

from premisa.llm.catalogue import QUERIES

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
from pyspark.sql import SparkSession

spark = (
    SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
    .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    .config("spark.checkpoint.dir", sys.argv[2]).config("spark.driver.memory", "4g").getOrCreate()
)
spark.sparkContext.setLogLevel("OFF")


def hidden(batches):
    import importlib.util

    for batch in batches:
        assert importlib.util.find_spec("premisa") is None
        yield batch


assert spark.range(4).mapInArrow(hidden, "id long").count() == 4
sys.path.insert(0, sys.argv[1])
import __spark_entry__

for name in sys.argv[4:]:
    print(name, __spark_entry__.queries()[name](spark, sys.argv[3]).count(), flush=True)
"""


@pytest.mark.parametrize("half", [0, 1])
def test_queries_run_where_the_package_is_not_installed(tmp_path, sf, half):
    names = sorted(QUERIES)[half::2]
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run(
        [sys.executable, str(script), REPO, str(tmp_path / "staged"), sf, *names],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900, check=False,
    )
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == names
