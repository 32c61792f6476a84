"""The log of scans, catalogs in files, and YAML files of several documents."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from basaltine.operators import config_checks, scans
from basaltine.sources import catalogs


def test_log_of_scans(spark):
    at = lambda k: F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(hours=k))
    asked = spark.createDataFrame([("a", "u", 1, None), ("b", "u", None, "x"), ("c", "v", 2, None)], "scan_id string, user_id string, repo_id int, code string")
    first = scans.begun(asked, at(0))
    assert {(r.scan_id, r.input_type, r.state) for r in first.collect()} == {("a", "repository", "PENDING"), ("b", "code", "PENDING"), ("c", "repository", "PENDING")}
    log = first
    for who, state, hour in (("a", "RUNNING", 1), ("a", "CANCELLED", 2), ("a", "COMPLETED", 3), ("b", "DELETED", 4), ("c", "RUNNING", 5)):
        log = log.unionByName(scans.marked(first.where(F.col("scan_id") == who), state, at(hour)))
    now = {r.scan_id: (r.state, r.finished_at and r.finished_at.hour) for r in scans.current(log).collect()}
    assert now == {"a": ("CANCELLED", 2), "c": ("RUNNING", None)}  # a cancelled scan stays cancelled
    repos = spark.createDataFrame([(1, "one")], "id int, name string")
    users = spark.createDataFrame([("u", None, "u@x")], "id string, full_name string, email string")
    got = [(r.scan_id, r.repository, r.user) for r in scans.recent(scans.current(log), repos, users, 5).collect()]
    assert got == [("a", "one", "u@x"), ("c", None, None)]


def test_catalogs(spark, tmp_path):
    path = str(tmp_path / "controls.json")
    with open(path, "w") as f:
        json.dump([{"control_id": "V1.1.1", "level": "1"}, {"control_id": "V1.1.2"}, {"level": "3"}, {"control_id": "V1.1.1", "level": "2"}], f)
    c = catalogs.controls(spark, path)
    assert {(r.control_id, r.level) for r in c.collect()} == {("V1.1.1", "2"), ("V1.1.2", None)}
    new = c.where("control_id = 'V1.1.2'").withColumn("level", F.lit("3"))
    assert {(r.control_id, r.level) for r in catalogs.seeded(c, new).collect()} == {("V1.1.1", "2"), ("V1.1.2", "3")}
    rules = str(tmp_path / "rules.json")
    with open(rules, "w") as f:
        json.dump({"A": {"name": "a"}}, f)
    os.utime(rules, (1_000_000, 1_000_000))
    held = catalogs.RuleFile(spark, rules)
    first = held.get()
    assert set(first.rules) == {"A"} and held.get() is first
    with open(rules, "w") as f:
        json.dump({"A": {"name": "a"}, "B": {"name": "b"}}, f)
    assert set(held.get().rules) == {"A", "B"}
    files = spark.createDataFrame([("x/a.py", "a.py"), ("x/b.py", "b.py"), ("package.json", "package.json"), ("package.json", "package.json")], "path string, name string")
    only = spark.createDataFrame([("x/a.py",)], "path string")
    assert sorted(r.path for r in catalogs.scanned_files(files, only, ["package.json"]).collect()) == ["package.json", "x/a.py"]
    assert catalogs.scanned_files(files, only.limit(0), ["package.json"]).count() == 3


def test_yaml_of_several_documents(spark):
    apart = "kind: PeerAuthentication\nname: x\n---\nmode: STRICT\n"
    whole = "kind: Other\n---\nkind: PeerAuthentication\nmode: STRICT\n"
    df = spark.createDataFrame([("a", "x.yaml", apart), ("w", "x.yml", whole)], "repo_id string, name string, content string")
    got = {(r.repo_id, r.control_id): r.verdict for r in config_checks.inspect(df).collect()}
    assert got["w", "V12.3.5"] == "pass" and ("a", "V12.3.5") not in got
