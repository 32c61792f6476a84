"""JSON documents against plain code."""

import json
import random

from pyspark.sql import functions as F

from basaltine.operators import config_checks, policies


def verdicts(content):
    try:
        doc = json.loads(content)
    except (ValueError, TypeError):
        return {}
    out = {}
    statements = doc.get("Statement") if isinstance(doc, dict) else None
    for s in statements if isinstance(statements, list) else []:
        if not isinstance(s, dict) or s.get("Effect") != "Allow":
            continue
        lists = [x if isinstance(x, list) else [x] if x else [] for x in (s.get("Action"), s.get("Resource"))]
        text = " ".join(map(str, lists[1] + lists[0])).lower()
        control = next((c for c, words in policies.ABOUT.items() if any(w in text for w in words)), policies.GENERAL)
        out[control] = "fail" if "*" in lists[0] + lists[1] or out.get(control) == "fail" else "pass"
    return out


def test_policies_like_plain_code(spark):
    rng = random.Random(2)
    parts = ["*", ["*"], ["s3:Get", "*"], "kms:Decrypt", ["SSM:x"], "logs:Put", ["arn:aws:logs:1"], [], "", None, ["a"], "b*"]

    def statement():
        items = [("Effect", rng.choice(["Allow", "Allow", "Allow", "Deny", "allow", True])), ("Action", rng.choice(parts)), ("Resource", rng.choice(parts)), ("Sid", "x")]
        rng.shuffle(items)
        return dict(items[: rng.choice([2, 3, 4, 4])])

    docs = [json.dumps({"Statement": [rng.choice([statement(), statement(), 7, "x", None]) for _ in range(rng.randrange(4))]}, indent=rng.choice([None, 2])) for _ in range(150)]
    docs += ['{"Statement": {"Effect": "Allow", "Action": "*"}}', '{"Statement": [', '[{"Statement": []}]', "7", '{"Other": 1, "note": "\\"Statement\\":"}', ""]
    df = spark.createDataFrame(list(enumerate(docs)), "k int, content string").withColumn("name", F.lit("p.json"))
    got = {}
    for r in config_checks.inspect(df).collect():
        got.setdefault(r.k, {})[r.control_id] = r.verdict
        assert r.confidence == (0.6 if r.verdict == "fail" else 0.4) and r.line is None
    assert got == {k: v for k, d in enumerate(docs) if (v := verdicts(d))}


def test_rotation(spark):
    docs = ['{"RotationEnabled": true}', '{"a": 1, "RotationEnabled" : false}', '{"RotationEnabled": "true"}', '{"RotationEnabled":', '{"x": {"RotationEnabled": true}}', '{"RotationEnabled": null}']
    df = spark.createDataFrame(list(enumerate(docs)), "k int, content string").withColumn("name", F.lit("secret.json"))
    assert {r.k: (r.verdict, r.confidence) for r in config_checks.inspect(df).collect()} == {0: ("pass", 0.6), 1: ("fail", 0.55)}


def test_first_value_depth_first(spark):
    def first(x):
        if isinstance(x, dict):
            for k in sorted(x):
                if k.lower() in ("age", "max_age"):
                    return x[k]
                if (f := first(x[k])) is not None:
                    return f
        for y in x if isinstance(x, list) else ():
            if (f := first(y)) is not None:
                return f
        return None

    rng = random.Random(3)

    def grow(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.randrange(100)
        if rng.random() < 0.4:
            return [grow(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["a", "b", "Age", "max_age", "z", "é"]) if rng.random() < 0.5 else f"k{i}": grow(depth - 1) for i in range(rng.randrange(4))}

    docs = [grow(5) for _ in range(120)] + [{}]
    rows = [(k, json.dumps(d)) for k, d in enumerate(docs)] + [(900, None), (901, "{")]
    got = {r.k: r.found for r in policies.find_first(spark.createDataFrame(rows, "k int, content string"), "content", "k", ["AGE", "max_age"]).collect()}
    want = {k: f for k, d in enumerate(docs) if (f := first(d)) is not None}
    assert {k: json.loads(v) for k, v in got.items()} == want and len(want) > 20
    assert policies.find_first(spark.createDataFrame([], "k int, content string"), "content", "k", ["a"]).count() == 0
