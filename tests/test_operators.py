import random

import duckdb
from pyspark.sql import functions as F

from basaltine.functions import answers, scoring, text
from basaltine.operators import classify, dedupe, joins, verdicts
from basaltine.operators.rules import Catalog, Rule, scan
from basaltine.plans import catalog
from basaltine.streaming import core
from basaltine.streaming.core import allowed


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_label_matches(spark):
    cases = [("get user_id", "user_id", True), ("get user_ids", "user_id", False), ("os.system(x)", "os.system(", True), ("", "a", False), ("a", "", False)]
    for label, pattern, want in cases:
        assert one(spark, text.label_matches(F.lit(label), F.lit(pattern))) is want, (label, pattern)


def test_normalize_sink(spark):
    for a in ("DB.Execute(x)", "  db.execute ( q )", "self.db.execute(q);", "db.execute"):
        assert one(spark, text.normalize_sink(F.lit(a))) == "db.execute"


def test_snippet_and_lines(spark):
    got = one(spark, text.snippet(F.lit("a\nb\nc\nd"), F.lit(2), F.lit(2), 1))
    assert got == "       1 | a\n>>>    2 | b\n       3 | c"
    assert one(spark, text.first_line_of(F.lit("a\nb1\nc2"), F.lit("[0-9]"))) == 2


def test_rules_are_checked_and_gated(spark):
    c = Catalog([Rule("A", regex_patterns=["foo", "(", "(a+)+"], severity="high", sanitizers=["safe"], languages=["en"])])
    assert c.rules["A"].regex_patterns == ["foo"]
    d = spark.createDataFrame([(1, "en", "x\nfoo foo"), (2, "de", "foo"), (3, None, "foo SAFE"), (4, "en", None), (5, "en", "")], "id long, lang string, text string")
    got = {r.id: (r.hits, r.first_line, r.severity, r.confidence) for r in scan(d, c, "text", "lang").collect()}
    assert got == {1: (2, 2, "high", "medium"), 3: (1, 1, "medium", "low")}


def test_islands_like_union_find(spark):
    rng = random.Random(5)
    rows = [(k, f"f{k % 3}", s, s + rng.randrange(6)) for k, s in enumerate(rng.randrange(60) for _ in range(60))]
    got = dedupe.islands(spark.createDataFrame(rows, "id long, file string, a long, b long"), ["file"], "a", "b", ["id"]).collect()
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, fi, a, b in rows:
        for j, fj, c, d in rows:
            if fi == fj and a <= d and c <= b:
                parent[find(i)] = find(j)
    mine, want = {}, {}
    for r in got:
        mine.setdefault((r.file, r.island), set()).add(r.id)
    for k in range(60):
        want.setdefault(find(k), set()).add(k)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_asof_and_band_like_brute_force(spark):
    rng = random.Random(7)
    left = [(k % 4, rng.randrange(40), k) for k in range(50)]
    right = [(k % 5, 2 * k % 41, k) for k in range(30)]
    a = spark.createDataFrame(left, "k long, t long, id long")
    b = spark.createDataFrame(right, "k long, u long, v long")
    back = {r.id: r.v for r in joins.asof_backward(a, b, ["k"], "t", "u", ["v"]).collect()}
    ahead = {r.id: r.v for r in joins.asof_forward(a, b, ["k"], "t", "u", ["v"]).collect()}
    for k, t, i in left:
        before = [(u, v) for kk, u, v in right if kk == k and u <= t]
        after = [(u, v) for kk, u, v in right if kk == k and u > t]
        assert (back[i] is None) == (not before) and (not before or right[back[i]][1] == max(before)[0])
        assert (ahead[i] is None) == (not after) and (not after or right[ahead[i]][1] == min(after)[0])
    near = {(r.id, r.v) for r in joins.band(a, b, ["k"], "t", "u", 3).collect()}
    assert near == {(i, v) for k, t, i in left for kk, u, v in right if k == kk and abs(t - u) <= 3}
    far = {r.id for r in joins.band(a, b, ["k"], "t", "u", 3, "left_anti").collect()}
    assert far == {i for _, _, i in left} - {i for i, _ in near}


def test_scores(spark):
    s = one(spark, scoring.path_score(F.lit(2), F.lit(0), F.lit(0), F.lit(0), F.lit(0.7)))
    assert abs(s - (0.35 / 3 + 0.125 + 0.1 + 0.07)) < 1e-12
    assert one(spark, scoring.score_severity(F.lit(0.45))) == "medium"
    assert one(spark, scoring.cvss(F.lit("critical"), F.lit(0.5))) == 9.5
    assert one(spark, scoring.percentage(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, scoring.percentage(F.lit(1), F.lit(8), 0)) == 12.0


def test_verdicts(spark):
    f = spark.createDataFrame([("a", "pass", 0.4), ("a", "fail", 0.3), ("b", "pass", None), ("c", "other", 0.9)], "c string, verdict string, confidence double")
    got = {r.c: (r.verdict, r.confidence) for r in verdicts.fail_wins(f, ["c"]).collect()}
    assert got == {"a": ("fail", 0.3), "b": ("pass", 0.0), "c": ("not_tested", 0.9)}
    got = {r.c: (r.verdict, r.confidence) for r in verdicts.pass_wins(f, ["c"]).collect()}
    assert got == {"a": ("pass", 0.4), "b": ("pass", 0.0), "c": ("not_tested", None)}
    assert verdicts.fail_wins(f.where("c = 'x'"), ["c"]).count() == 0


def test_classification(spark):
    f = spark.createDataFrame(
        [("SQL_INJECTION", "high", "dfg", "cur.execute(q, (a,))"), ("SQL_INJECTION", "high", "dfg", "cur.execute(q + a)"), ("X", "low", "regex", None)],
        "rule_id string, confidence string, pattern_type string, code string",
    )
    assert [(r.classification, r.final_confidence) for r in classify.static(f).collect()] == [("SAFE", 0.9), ("VULNERABLE", 0.85), ("VULNERABLE", 0.45)]
    words = spark.createDataFrame([("Critical",), ("HIGH",), ("medium",), ("low",), ("odd",), (None,)], "confidence string")
    assert [r[0] for r in words.select(classify.static_confidence(F.col("confidence"))).collect()] == [0.9, 0.85, 0.65, 0.45, 0.65, 0.65]

    def broken(b):
        raise RuntimeError

    schema = f"{', '.join(f'{n} {k}' for n, k in f.dtypes)}, classification string, final_confidence double, explanation string"
    assert classify.classified_by(f, broken, schema).where("final_confidence = 0.5").count() == 3


def test_answers_of_a_model_are_kept_and_outages_are_not(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def model(prompts):
        import uuid

        import pandas as pd

        (log / uuid.uuid4().hex).write_text("\n".join(prompts))
        if prompts.str.contains("outage").any() and not (log / "up").exists():
            raise TimeoutError
        said = prompts.map(lambda p: None if "mute" in p else "SAFE" if "good" in p else "VULNERABLE")
        return pd.DataFrame({"classification": said, "severity": "critical", "confidence": 0.7, "explanation": "said"})

    def asked():
        out = sorted(p for f in log.iterdir() if f.name != "up" for p in f.read_text().splitlines())
        for f in log.iterdir():
            if f.name != "up":
                f.unlink()
        return out

    rows = [("s", "X", "high", "high", "dfg", code) for code in ("good", "bad", "bad", "mute", "", None, "outage")]
    rows += [("s", "WEAK_CRYPTO", "low", "low", "REGEX", "md5"), ("t", "X", "low", "critical", "dfg", "first"), ("t", "X", "low", "low", "dfg", "later")]
    f = spark.createDataFrame(rows, "scan_id string, rule_id string, severity string, confidence string, pattern_type string, code string")
    c = classify.CachedClassifier(spark, str(tmp_path / "kept"), model, batch=1)
    prompt = F.concat(F.lit("? "), "code")
    got = sorted(map(tuple, c.run(f, prompt, per_scan=6).select("code", "is_vulnerable", "final_severity", "final_confidence").collect()), key=str)
    assert ("good", False, "low", 0.9) in got and got.count(("bad", True, "critical", 0.7)) == 2
    assert {("mute", True, "high", 0.85), ("", True, "high", 0.85), ("outage", True, "high", 0.85), ("md5", True, "low", 0.45)} <= set(got)
    assert asked() == ["? bad", "? first", "? good", "? later", "? mute"] and c.asked == 5  # the outage is beyond a budget of six
    c.run(f, prompt, per_scan=7)
    assert asked() == ["? mute", "? outage"]
    (log / "up").write_text("")
    again = classify.CachedClassifier(spark, str(tmp_path / "kept"), model, batch=1)
    got = again.run(f, prompt, per_scan=7)
    assert ("outage", True, "critical", 0.7) in [tuple(r) for r in got.select("code", "is_vulnerable", "final_severity", "final_confidence").collect()]
    assert asked() == ["? mute", "? outage"]
    again.run(f.where("code <> 'mute'"), prompt, per_scan=7)
    assert again.asked == 0 and asked() == []


def test_limiter_does_not_count_denied_calls():
    assert allowed([0, 1, 2, 3, 11, 12], [], 10, 2)[0] == [True, True, False, False, True, True]


def test_public_urls_and_routes(spark):
    from basaltine.functions.web import is_private, is_public_url, route_regex

    for a, want in (("10.1.2.3", True), ("172.32.0.1", False), ("192.168.0.9", True), ("8.8.8.8", False), ("300.1.1.1", False), ("x", False), ("127.0.0.1", True)):
        assert one(spark, is_private(F.lit(a))) is want, a
    for u, want in (("https://a.org/x", True), ("ftp://a.org", False), ("http://u@a.org", False), ("http://10.0.0.1/", False), ("http://localhost:80", False), (None, False)):
        assert one(spark, is_public_url(F.lit(u))) is want, u
    assert one(spark, F.regexp_like(F.lit("/u/12/x"), route_regex(F.lit("/u/<int:id>/<name>"))))
    assert not one(spark, F.regexp_like(F.lit("/u/a/x"), route_regex(F.lit("/u/<int:id>/<name>"))))


def test_interval_anti_on_a_hot_key_with_nulls(spark):
    rng = random.Random(4)
    left = [(k, rng.choice(["h", "h", "i", None]), *sorted((rng.randrange(300), rng.randrange(300)))) for k in range(120)] + [(500, "h", None, 3), (501, "h", 5, None), (502, "h", 9, 2)]
    right = [(rng.choice(["h", "i", None]), s, s + rng.randrange(9)) for s in (rng.randrange(300) for _ in range(12))] + [("h", 7, 1), ("h", None, 900)]
    got = joins.interval_anti(spark.createDataFrame(left, "id int, k string, s int, e int"), spark.createDataFrame(right, "k string, s int, e int"), ["k"], "s", "e")

    def meets(k, s, e):
        ok = None not in (k, s, e) and s <= e
        return ok and any(k == rk and rs is not None and rs <= re_ and s <= re_ and rs <= e for rk, rs, re_ in right)

    assert sorted(r.id for r in got.collect()) == sorted(i for i, k, s, e in left if not meets(k, s, e))


def test_limiter_sorts_all_of_a_key_and_tokens_expire(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        times = [(1, k, (k * 37) % 101) for k in range(101)]
        spark.createDataFrame(times, "user_id long, event_id long, us long").coalesce(1).write.parquet(str(tmp_path / "e"))
        stream = spark.readStream.schema("user_id long, event_id long, us long").parquet(str(tmp_path / "e"))
        got = {r.event_id: r.allowed for r in core.finished(core.rate_limited(stream, 10, 3), "append").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    in_order = sorted(times, key=lambda t: (t[2], t[1]))
    want, _ = core.allowed([t[2] for t in in_order], [], 10, 3)
    assert got == {t[1]: ok for t, ok in zip(in_order, want)}
    asked = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5), (None, 5)], "token string, at int")
    gone = spark.createDataFrame([("a", 6), ("b", 5), (None, 9)], "token string, expires_at int")
    assert {r.token for r in core.accepted(asked, gone).collect()} == {"b", "c", None}


def test_stalled_runs_are_sessions_to_the_millisecond(spark, tmp_path):
    rng = random.Random(8)
    hour = 3_600_000_000
    rows = [(k, rng.randrange(40) * hour + rng.choice([-1000, -1, 0, 1, 999, 1000, 1001]), rng.randrange(1, 5)) for k in range(150)]
    rows += [*rows[:40], *((k, us, user + 1) for k, us, user in rows[40:60]), *((k, us + 5000, user) for k, us, user in rows[60:80])]  # copies, other users' events with the same id, other times
    con = duckdb.connect()
    con.execute("CREATE TABLE raw (event_id BIGINT, us BIGINT, user_id BIGINT)")
    con.executemany("INSERT INTO raw VALUES (?, ?, ?)", rows)
    con.execute("CREATE TABLE events AS SELECT event_id, make_timestamp(1704067200000000 + us) AS ts, user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '' AS props FROM raw")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = sorted(map(tuple, catalog.QUERIES["stream_stalls"](spark, str(tmp_path)).select("user_id", "start_ms", "last_ms", "n").collect()))
    want = sorted(con.sql(f"SELECT user_id, start_ms, last_ms, n FROM ({catalog.ORACLE['stream_stalls']})").fetchall())
    assert len(want) > 10 and got == want
    events = core.source(spark, str(tmp_path), "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at"))
    plan = core.stalls(events.withWatermark("at", "1 hour"), 7_200_000)._jdf.queryExecution().analyzed().toString()
    assert "SessionWindow" in plan or "session_window" in plan
    assert "PySpark" not in plan and "Python" not in plan  # no state in Python, which a key's timers made slow


def test_evidence_that_a_finding_is_harmless(spark):
    cases = [
        ("SQL_INJECTION", "cursor.execute('select ? from t', (x,))", True), ("SQL_INJECTION", "cursor.execute('select ' + x)", False), ("SQL_INJECTION", "s.query(U).filter(U.id == x)", True),
        ("NOSQL_INJECTION", "if (typeof q.name !== 'string') return", True), ("COMMAND_INJECTION", "subprocess.run(['ls', x])", True), ("COMMAND_INJECTION", "subprocess.run(['ls'], shell=True)", False),
        ("COMMAND_INJECTION", "os.system('ls ' + shlex.quote(x))", True), ("COMMAND_INJECTION", "execFile('git', [x])", True), ("CODE_INJECTION", "re.compile(x)", True), ("CODE_INJECTION", "eval(x)", False),
        ("PATH_TRAVERSAL", "name = request.args['f']", True), ("PATH_TRAVERSAL", "open(request.args['f'])", False), ("PATH_TRAVERSAL", "p = realpath(x)\nif p.startswith(ROOT): open(p)", True),
        ("BROKEN_ACCESS_CONTROL", "if (doc.owner !== 1 || req.user.role !== 'admin') return", True), ("IDOR", "get(id)", False), ("PATH_DISCOVERY", "yaml.load(x, Loader=SafeLoader)", True),
        ("PATH_DISCOVERY", "logger.info(username)", True), ("PATH_DISCOVERY", "logger.info(username); logger.info(password)", False), ("REGEX_DOS", "re.match('a+b', x)", True), ("REGEX_DOS", "re.match('(a+)+', x)", False),
        ("XSS", "el.textContent = x", True), ("XSS", "el.innerHTML = x", False), ("XSS", "html.escape(x)", True), ("TEMPLATE_INJECTION", "render_template_string('x' + y)", False), ("SSRF", "fetch('/api')", True),
        ("SSRF", "fetch('//evil')", False), ("SSRF", "if host in ALLOWED_HOSTS: get(host)", True), ("INSECURE_RANDOM", "const color = Math.random()", True), ("INSECURE_RANDOM", "color = token = Math.random()", False),
        ("ANYTHING", "defusedxml.parse(x)", True), ("ANYTHING", "", False),
    ]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, rule string, code string, want boolean")
    wrong = rows.withColumn("got", classify.is_safe(F.col("rule"), F.col("code"))).where("got <> want").collect()
    assert wrong == []


def test_answers_of_a_model(spark):
    cases = {
        '```json\n{"a": 1, "b": ["x",],}\n```': (1, ["x"]),
        'Sure! {"a": 2, "b": []} hope this helps': (2, []),
        '```\n{"a": 3}': (3, None),
        '{"a": 4, "b": ["line\nend"]}': (4, ["line\nend"]),
        "no json": None,
        '{"a": oops': None,
        '{"a": oops}': None,
        "": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", answers.answer(F.col("t"), "a int, b array<string>").alias("r"))
    assert {r.t: r.r and (r.r.a, r.r.b) for r in df.collect()} == cases
    assert one(spark, answers.iso(F.lit("2024-01-02 03:04:05").cast("timestamp"))) == "2024-01-02T03:04:05.000000Z"
    assert [one(spark, answers.chapter_number(F.lit(c))) for c in ("V2", "V10", "X")] == [2, 10, 2**31 - 1]
