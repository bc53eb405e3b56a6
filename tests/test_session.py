import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
from patchsieve.session import cut_lineage, local_session, new_folder, shared_folder
spark = local_session("1", "plain")
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_folder(spark) == shared_folder(spark) and new_folder(spark, "a") != new_folder(spark, "a")
assert cut_lineage(spark.range(5)).count() == 5
print("fine")
"""


def test_a_local_session_without_a_named_folder(tmp_path):
    """No preset setting: the folder is the session's own, and nothing is set while the session runs."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": REPO, "PATCHSIEVE_DRIVER_MEMORY": "1g"}
    run = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in run.stdout, run.stderr[-2000:]
