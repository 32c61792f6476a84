"""Sending the package to workers that don't have it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from basaltine.session import local_session, ship
from basaltine.sources import html_graph
spark = local_session(2)
ship(spark)
ship(spark)
df = spark.createDataFrame([("p", "<a href=x>y</a>")], "file string, content string")
print("links", html_graph.nodes(df).count())
"""


def test_workers_get_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "links 1" in out.stdout, out.stderr[-2000:]
