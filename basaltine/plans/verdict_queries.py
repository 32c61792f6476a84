"""Verdicts, compliance, dashboards and scores; orders and line items stand for findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltine.functions import scoring
from basaltine.functions.time import epoch_day
from basaltine.operators import classify, verdicts
from basaltine.plans.registry import query
from basaltine.session import new_folder, table

VERDICT_SQL = """CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'O' THEN 'pass' ELSE 'not_tested' END"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a control (the customer): a verdict by status, a confidence by key."""
    o = table(spark, sf_dir, "orders")
    v = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "O", "pass").otherwise("not_tested")
    conf = (F.col("o_orderkey") % 10).cast("double") / 10
    return o.select(F.col("o_custkey").alias("control_id"), v.alias("verdict"), conf.alias("confidence"), "o_orderkey", "o_orderpriority")


FINDINGS_SQL = f"""f AS (SELECT o_custkey AS control_id, {VERDICT_SQL} AS verdict, (o_orderkey % 10)::DOUBLE / 10 AS confidence,
o_orderkey, o_orderpriority FROM orders)"""


@query(
    "verdict_config",
    f"""WITH {FINDINGS_SQL} SELECT control_id, CASE WHEN bool_or(verdict = 'fail') THEN 'fail' WHEN bool_or(verdict = 'pass') THEN 'pass' ELSE 'not_tested' END AS verdict,
    CASE WHEN bool_or(verdict = 'fail') THEN max(confidence) FILTER (verdict = 'fail') ELSE max(confidence) END AS confidence FROM f GROUP BY 1""",
)
def verdict_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.fail_wins(_findings(spark, sf_dir), ["control_id"])


@query(
    "verdict_config_or_probe",
    f"""WITH {FINDINGS_SQL} SELECT control_id, CASE WHEN bool_or(verdict = 'fail') THEN 'fail' WHEN bool_or(verdict = 'pass') THEN 'pass' ELSE 'not_tested' END AS verdict,
    coalesce(max(confidence) FILTER (verdict = 'fail'), max(confidence) FILTER (verdict = 'pass')) AS confidence FROM f GROUP BY 1""",
)
def verdict_config_or_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.any_fail_wins(_findings(spark, sf_dir), ["control_id"])


@query(
    "verdict_pass_wins",
    f"""WITH {FINDINGS_SQL} SELECT control_id, CASE WHEN bool_or(verdict = 'pass') THEN 'pass' WHEN bool_or(verdict = 'fail') THEN 'fail' ELSE 'not_tested' END AS verdict,
    coalesce(max(confidence) FILTER (verdict = 'pass'), max(confidence) FILTER (verdict = 'fail')) AS confidence FROM f GROUP BY 1""",
)
def verdict_pass_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.pass_wins(_findings(spark, sf_dir), ["control_id"])


@query(
    "verdict_static",
    f"""WITH {FINDINGS_SQL}, h AS (SELECT control_id, bool_or(verdict <> 'pass' AND o_orderpriority = '1-URGENT') AS confirmed, bool_or(verdict <> 'pass') AS violated,
    arg_min(confidence, o_orderkey) FILTER (verdict <> 'pass' AND o_orderpriority = '1-URGENT') AS c1, arg_min(confidence, o_orderkey) FILTER (verdict <> 'pass') AS c2,
    arg_min(confidence, o_orderkey) AS c3 FROM f WHERE o_orderkey % 3 = 0 GROUP BY 1),
    cap AS (SELECT control_id, arg_min(verdict, o_orderkey) AS v, arg_min(confidence, o_orderkey) AS c FROM f WHERE o_orderkey % 50 = 1 GROUP BY 1)
    SELECT c_custkey AS control_id, CASE WHEN cap.v IS NOT NULL THEN cap.v WHEN confirmed THEN 'fail' WHEN violated THEN 'manual_review' WHEN h.control_id IS NOT NULL THEN 'pass'
    WHEN c_custkey % 4 <> 0 AND c_custkey % 8 <> 3 THEN 'pass' ELSE 'not_tested' END AS verdict,
    CASE WHEN cap.v IS NOT NULL THEN cap.c WHEN confirmed THEN c1 WHEN violated THEN c2 WHEN h.control_id IS NOT NULL THEN c3
    WHEN c_custkey % 4 <> 0 AND c_custkey % 8 <> 3 THEN 0.6 END AS confidence
    FROM customer LEFT JOIN h ON h.control_id = c_custkey LEFT JOIN cap ON cap.control_id = c_custkey""",
)
def verdict_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir).withColumnRenamed("o_orderkey", "ord")
    controls = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("control_id"))
    hits = f.where("ord % 3 = 0").select(
        "control_id", "ord", (F.col("verdict") == "pass").alias("compliant"), (F.col("o_orderpriority") == "1-URGENT").alias("confirmed"), "confidence"
    )
    rules = controls.where("control_id % 4 <> 0").select("control_id", (F.col("control_id") % 8 == 3).alias("compliant"))
    capability = f.where("ord % 50 = 1").select("control_id", "ord", "verdict", "confidence")
    return verdicts.static_verdicts(controls, hits, rules, capability)


@query(
    "verdict_merge",
    f"""WITH {FINDINGS_SQL}, g AS (SELECT control_id, o_orderpriority AS strategy, bool_or(verdict = 'fail') AS f, bool_or(verdict = 'pass') AS p,
    arg_min(verdict, o_orderkey) AS first FROM f GROUP BY ALL)
    SELECT control_id, strategy, CASE strategy WHEN '1-URGENT' THEN CASE WHEN f THEN 'fail' WHEN p THEN 'pass' ELSE 'not_tested' END
    WHEN '2-HIGH' THEN CASE WHEN p THEN 'pass' WHEN f THEN 'fail' ELSE 'not_tested' END WHEN '3-MEDIUM' THEN first ELSE 'not_tested' END AS verdict FROM g""",
)
def verdict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = (
        _findings(spark, sf_dir)
        .groupBy("control_id", F.col("o_orderpriority").alias("strategy"))
        .agg(
            F.bool_or(F.col("verdict") == "fail").alias("f"),
            F.bool_or(F.col("verdict") == "pass").alias("p"),
            F.min_by("verdict", "o_orderkey").alias("first"),
        )
    )
    fail_first = F.when(F.col("f"), "fail").when(F.col("p"), "pass").otherwise("not_tested")
    pass_first = F.when(F.col("p"), "pass").when(F.col("f"), "fail").otherwise("not_tested")
    s = F.col("strategy")
    out = F.when(s == "1-URGENT", fail_first).when(s == "2-HIGH", pass_first).when(s == "3-MEDIUM", F.col("first")).otherwise("not_tested")
    return g.select("control_id", "strategy", out.alias("verdict"))


@query(
    "chapter_verdict_pivot",
    """SELECT o_orderpriority AS chapter, count(*) FILTER (o_orderstatus = 'O') AS pass, count(*) FILTER (o_orderstatus = 'F') AS fail, count(*) FILTER (o_orderstatus = 'X') AS manual_review,
    count(*) FILTER (o_orderstatus = 'P') AS not_tested, CAST(0 AS BIGINT) AS not_applicable, count(*) AS total FROM orders GROUP BY 1""",
)
def chapter_verdict_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir).withColumnRenamed("o_orderpriority", "chapter")
    return verdicts.verdict_pivot(f, ["chapter"])


@query(
    "level_completion",
    """WITH r AS (SELECT CASE WHEN p_size <= 15 THEN 1 WHEN p_size <= 35 THEN 2 ELSE 3 END AS lv, p_type = 'PROMO' OR p_size % 3 = 0 AS ok FROM part)
    SELECT 'L' || t AS level, count(*) AS total, count(*) FILTER (ok) AS passed, round_even(100.0::DOUBLE * count(*) FILTER (ok) / count(*), 1)::DOUBLE AS pct
    FROM r, (VALUES (1), (2), (3)) v(t) WHERE lv <= t GROUP BY t""",
)
def level_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    level = F.when(size <= 15, "L1").when(size <= 35, "L2").otherwise("L3")
    ok = F.when((F.col("p_type") == "PROMO") | (size % 3 == 0), "pass").otherwise("fail")
    return verdicts.level_completion(table(spark, sf_dir, "part").select(level.alias("level"), ok.alias("verdict")))


@query(
    "chapter_strategies",
    """SELECT o_orderpriority AS chapter, count(*) AS controls, CASE WHEN count(DISTINCT k) = 1 THEN min(k) ELSE 'mixed' END AS strategy
    FROM (SELECT o_orderpriority, CASE WHEN o_orderpriority < '3' THEN 'static' ELSE o_orderstatus END AS k FROM orders) GROUP BY 1""",
)
def chapter_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.when(F.col("o_orderpriority") < "3", "static").otherwise(F.col("o_orderstatus"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("chapter"), k.alias("k"))
    one = F.when(F.min("k") == F.max("k"), F.min("k")).otherwise("mixed")
    return o.groupBy("chapter").agg(F.count("*").alias("controls"), one.alias("strategy"))


@query(
    "portfolio_top_failing",
    f"""WITH {FINDINGS_SQL} SELECT c_nationkey AS control, count(*) AS fails, min(o_orderkey) AS first_seen FROM f JOIN customer ON control_id = c_custkey
    WHERE verdict = 'fail' GROUP BY 1 ORDER BY fails DESC, first_seen LIMIT 5""",
)
def portfolio_top_failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("control_id"), F.col("c_nationkey").alias("control"))
    f = _findings(spark, sf_dir).where("verdict = 'fail'").join(c, "control_id")
    top = f.groupBy("control").agg(F.count("*").alias("fails"), F.min("o_orderkey").alias("first_seen"))
    return top.orderBy(F.desc("fails"), "first_seen").limit(5)


@query(
    "portfolio_average",
    f"""WITH {FINDINGS_SQL}, s AS (SELECT c_nationkey AS repo, round_even(100.0::DOUBLE * count(*) FILTER (verdict = 'pass') / count(*), 0)::DOUBLE AS pct
    FROM f JOIN customer ON control_id = c_custkey GROUP BY 1)
    SELECT count(*) AS repos, round_even(avg(pct), 1)::DOUBLE AS average, min(pct) AS worst FROM s""",
)
def portfolio_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("control_id"), F.col("c_nationkey").alias("repo"))
    f = _findings(spark, sf_dir).join(c, "control_id").groupBy("repo")
    s = f.agg(scoring.percentage(F.count_if(F.col("verdict") == "pass"), F.count("*"), 0).alias("pct"))
    return s.agg(F.count("*").alias("repos"), F.bround(F.avg("pct"), 1).alias("average"), F.min("pct").alias("worst"))


@query(
    "risk_score",
    """WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error') AS c, count(*) FILTER (event_type = 'purchase') AS h, count(*) FILTER (event_type = 'click') AS m,
    count(*) FILTER (event_type = 'view') AS l FROM events GROUP BY 1, 2), s AS (SELECT *, least(100.0, round_even(10 * c + 5 * h + 2 * m + l / 2, 0))::DOUBLE AS score FROM c)
    SELECT user_id, day, score, CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS band FROM s""",
)
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    def n(kind):
        return F.count_if(F.col("event_type") == kind)

    e = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day"))
    s = e.agg(scoring.risk_score(n("error"), n("purchase"), n("click"), n("view")).alias("score"))
    return s.select("user_id", "day", "score", scoring.risk_band(F.col("score")).alias("band"))


@query(
    "severity_histogram",
    """SELECT o_custkey, count(*) FILTER (p = 1) AS critical, count(*) FILTER (p = 2) AS high, count(*) FILTER (p = 3) AS medium, count(*) FILTER (p = 4) AS low,
    count(*) FILTER (p > 4) AS other FROM (SELECT o_custkey, CAST(substr(o_orderpriority, 1, 1) AS INT) AS p FROM orders) GROUP BY 1""",
)
def severity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("p"))
    counts = [F.count_if(F.col("p") == k).alias(n) for k, n in enumerate(("critical", "high", "medium", "low"), 1)]
    return o.groupBy("o_custkey").agg(*counts, F.count_if(F.col("p") > 4).alias("other"))


@query(
    "report_compare",
    """WITH s AS (SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang IN ('en', 'fr') GROUP BY ALL)
    SELECT coalesce(a.source, b.source) AS source, coalesce(a.n, 0) - coalesce(b.n, 0) AS d_docs, coalesce(a.chars, 0) - coalesce(b.chars, 0) AS d_chars
    FROM (SELECT * FROM s WHERE lang = 'en') a FULL JOIN (SELECT * FROM s WHERE lang = 'fr') b ON a.source = b.source""",
)
def report_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("lang") == "en", 1).otherwise(-1)
    d = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "fr"))
    return d.groupBy("source").agg(F.sum(sign).alias("d_docs"), F.sum(sign * F.col("n_chars")).alias("d_chars"))


@query(
    "sla_breach",
    """WITH d AS (SELECT o_custkey, o_orderkey, DATE '1998-08-02' - CAST(o_orderdate AS DATE) AS days, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 7 WHEN '2' THEN 30 WHEN '3' THEN 90 ELSE 180 END AS sla
    FROM orders WHERE o_orderdate < TIMESTAMP '1998-08-02'),
    g AS (SELECT o_custkey, bool_or(days > sla) AS breached, min(sla) FILTER (days > sla) AS worst, count(*) AS n FROM d GROUP BY 1)
    SELECT c_custkey, CASE WHEN n IS NULL THEN 'pass' WHEN breached THEN 'fail' ELSE 'manual_review' END AS verdict, CAST(worst AS BIGINT) AS worst_sla
    FROM customer LEFT JOIN g ON c_custkey = o_custkey""",
)
def sla_breach(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low", "low"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    o = table(spark, sf_dir, "orders").where("o_orderdate < TIMESTAMP_NTZ'1998-08-02 00:00:00'")
    o = o.select("o_custkey", (F.lit(10440) - epoch_day("o_orderdate")).alias("days"), scoring.lookup(scoring.SLA_DAYS, severity, 180).alias("sla"))
    late = F.col("days") > F.col("sla")
    g = o.groupBy("o_custkey").agg(F.bool_or(late).alias("breached"), F.min(F.when(late, F.col("sla"))).alias("worst"), F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(g, F.col("c_custkey") == F.col("o_custkey"), "left")
    verdict = F.when(F.col("n").isNull(), "pass").when(F.col("breached"), "fail").otherwise("manual_review")
    return c.select("c_custkey", verdict.alias("verdict"), F.col("worst").cast("long").alias("worst_sla"))


@query(
    "cvss_and_path_score",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (l_partkey % 8 + 1)::DOUBLE AS n, l_suppkey % 4 AS b, l_orderkey % 5 = 0 AS ex, l_orderkey % 7 = 0 AS he, l_linenumber % 3 AS g FROM lineitem),
    s AS (SELECT *, 0.35::DOUBLE / (1.0 + n) + 0.25::DOUBLE / n + 0.2::DOUBLE * least(1.0::DOUBLE, b * 0.2::DOUBLE) + 0.1::DOUBLE * (CASE WHEN ex THEN 0.0 WHEN he THEN 0.4 ELSE 1.0 END)::DOUBLE
    + 0.1::DOUBLE * (CASE g WHEN 0 THEN 0.2 WHEN 1 THEN 0.7 ELSE 0.5 END)::DOUBLE AS raw FROM x),
    t AS (SELECT *, CASE WHEN ex OR he THEN raw * greatest(0.3::DOUBLE, 1.0::DOUBLE - 0.15::DOUBLE * ex::INT - 0.05::DOUBLE * he::INT) ELSE raw END AS score FROM s)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(score, 6) AS score, CASE WHEN score >= 0.75 THEN 'critical' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS severity FROM t""",
)
def cvss_and_path_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    explicit, heuristic = (F.col("l_orderkey") % 5 == 0).cast("int"), (F.col("l_orderkey") % 7 == 0).cast("int")
    g = F.col("l_linenumber") % 3
    score = scoring.path_score(F.col("l_partkey") % 8 + 1, F.col("l_suppkey") % 4, explicit, heuristic, scoring.auth_gap(g == 0, g == 1))
    out = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", score.alias("s"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.round("s", 6).alias("score"), scoring.score_severity(F.col("s")).alias("severity"))


@query(
    "cvss_numbers",
    """WITH x AS (SELECT o_orderkey, ['critical', 'high', 'medium', 'low', 'info'][CAST(substr(o_orderpriority, 1, 1) AS INT)] AS severity, (o_orderkey % 9 - 1)::DOUBLE / 7 AS c FROM orders),
    b AS (SELECT *, CASE severity WHEN 'critical' THEN 9.0 WHEN 'high' THEN 7.0 WHEN 'medium' THEN 4.0 WHEN 'low' THEN 0.1 ELSE 0.0 END::DOUBLE AS low,
    CASE severity WHEN 'critical' THEN 10.0 WHEN 'high' THEN 8.9 WHEN 'medium' THEN 6.9 WHEN 'low' THEN 3.9 ELSE 0.0 END::DOUBLE AS high FROM x),
    n AS (SELECT o_orderkey, severity, round(low + (high - low) * least(1.0::DOUBLE, greatest(0.0::DOUBLE, c)), 1) AS number FROM b)
    SELECT *, CASE WHEN number >= 9.0 THEN 'critical' WHEN number >= 7.0 THEN 'high' WHEN number >= 4.0 THEN 'medium' ELSE 'low' END AS band FROM n""",
)
def cvss_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("critical", "high", "medium", "low", "info")))
    severity = F.element_at(names, F.substring("o_orderpriority", 1, 1).cast("int"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", severity.alias("severity"), ((F.col("o_orderkey") % 9 - 1).cast("double") / 7).alias("c"))
    o = o.withColumn("number", scoring.cvss(F.col("severity"), F.col("c")))
    return o.select("o_orderkey", "severity", "number", scoring.cvss_band(F.col("number")).alias("band"))


@query(
    "combine_results",
    """WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'VULNERABLE' WHEN 'O' THEN 'SAFE' ELSE 'UNKNOWN' END AS m, CAST(substr(o_orderpriority, 1, 1) AS INT) AS s, o_orderkey % 4 + 1 AS ms, (o_orderkey % 10)::DOUBLE / 10 AS sc, (o_orderkey % 7)::DOUBLE / 7 AS mc FROM orders)
    SELECT o_orderkey, m = 'VULNERABLE' AS vulnerable, CASE m WHEN 'SAFE' THEN 'low' WHEN 'VULNERABLE' THEN ['critical', 'high', 'medium', 'low', 'info'][ms] ELSE ['critical', 'high', 'medium', 'low', 'info'][least(s, ms)] END AS severity,
    CASE m WHEN 'SAFE' THEN 0.9 WHEN 'UNKNOWN' THEN (sc + mc) / 2 ELSE mc END AS confidence FROM x""",
)
def combine_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("critical", "high", "medium", "low", "info")))
    o = table(spark, sf_dir, "orders")
    model = F.when(F.col("o_orderstatus") == "F", "VULNERABLE").when(F.col("o_orderstatus") == "O", "SAFE").otherwise("UNKNOWN")
    static_severity = F.element_at(names, F.substring("o_orderpriority", 1, 1).cast("int"))
    model_severity = F.element_at(names, (F.col("o_orderkey") % 4 + 1).cast("int"))
    sc, mc = (F.col("o_orderkey") % 10).cast("double") / 10, (F.col("o_orderkey") % 7).cast("double") / 7
    v, s, c = scoring.combine(F.lit("x"), model, static_severity, model_severity, sc, mc)
    return o.select("o_orderkey", v.alias("vulnerable"), s.alias("severity"), c.alias("confidence"))


@query(
    "grouping_rollup",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
)
def grouping_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus")
    return li.agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))


@query(
    "grouping_cube",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
)
def grouping_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus")
    return li.agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))


@query(
    "attestation_latest",
    """SELECT user_id, event_type AS control_id, arg_max(value, (ts, event_id)) AS answer, max(event_id) FILTER (true) AS any_id FROM events GROUP BY ALL""",
)
def attestation_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.col("event_type").alias("control_id")).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("answer"), F.max("event_id").alias("any_id")
    )


@query(
    "path_confidence",
    """SELECT l_orderkey, round(avg(1 - l_discount), 6) AS confidence, count(DISTINCT l_suppkey) - 1 + count(DISTINCT l_returnflag) - 1 AS crossings,
    CASE WHEN bool_or(l_tax >= 0.07) THEN 'high' WHEN bool_or(l_tax >= 0.04) THEN 'medium' ELSE 'low' END AS uncertainty FROM lineitem GROUP BY 1""",
)
def path_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = F.when(F.bool_or(F.col("l_tax") >= 0.07), "high").when(F.bool_or(F.col("l_tax") >= 0.04), "medium").otherwise("low")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.avg(1 - F.col("l_discount")), 6).alias("confidence"),
        (F.countDistinct("l_suppkey") + F.countDistinct("l_returnflag") - 2).alias("crossings"),
        worst.alias("uncertainty"),
    )


SAFE_CODE, BAD_CODE = 'cur.execute("select a from b where c = ?", (x,))', "cur.execute(q + x)"


@query(
    "static_classification",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 THEN 'SAFE' ELSE 'VULNERABLE' END AS classification,
    CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 THEN 0.9::DOUBLE ELSE [0.9, 0.85, 0.65, 0.45, 0.65][CAST(substr(o_orderpriority, 1, 1) AS INT)] END AS confidence FROM orders""",
)
def static_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    words = F.array(*map(F.lit, ("Critical", "high", "MEDIUM", "low", "none")))
    f = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 2 == 1, "SQL_INJECTION").otherwise("XSS").alias("rule_id"),
        F.element_at(words, F.substring("o_orderpriority", 1, 1).cast("int")).alias("confidence"),
        F.when(key % 3 == 0, SAFE_CODE).otherwise(BAD_CODE).alias("code"),
    )
    return classify.static(f).select("o_orderkey", "classification", F.col("final_confidence").alias("confidence"))


@query(
    "cached_classification",
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey % 40 AS code, l_linenumber % 3 AS c, l_partkey % 5 = 0 AS presence FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, presence ORDER BY c DESC, l_orderkey, l_linenumber) AS k FROM f),
    m AS (SELECT *, CASE WHEN k <= 100 AND NOT presence THEN code % 4 END AS answer, [0.45, 0.65, 0.85][c + 1] AS static, [0.3, 0.6, 0.9][c + 1] AS word FROM r)
    SELECT l_orderkey, l_linenumber, coalesce(answer, 3) <> 0 AS is_vulnerable, CASE answer WHEN 0 THEN 'low' WHEN 1 THEN 'critical' ELSE 'high' END AS final_severity,
    CASE answer WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 WHEN 2 THEN (word + 0.4) / 2 ELSE static END AS final_confidence FROM m""",
)
def cached_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that leaves a fourth of the prompts unanswered, asked for half of the findings first and for all of them then."""
    import pandas as pd

    def model(prompts: pd.Series) -> pd.DataFrame:
        n = prompts.str.extract(r"call\((\d+)\)")[0].astype(int) % 4
        words = n.map({0: "SAFE", 1: "VULNERABLE", 2: "LIKELY_VULNERABLE"})  # none for 3
        return pd.DataFrame({"classification": words, "severity": n.map({1: "critical"}).fillna("low"), "confidence": n.map({1: 0.7}).fillna(0.4), "explanation": "model"})

    c = F.get(F.array(*map(F.lit, ("low", "medium", "high"))), F.col("l_linenumber") % 3)
    f = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_suppkey").alias("scan_id"),
        F.when(F.col("l_partkey") % 5 == 0, "WEAK_CRYPTO").otherwise("SQL_INJECTION").alias("rule_id"),
        F.lit("high").alias("severity"),
        c.alias("confidence"),
        F.lit("REGEX").alias("pattern_type"),
        F.concat(F.lit("call("), F.col("l_partkey") % 40, F.lit(")")).alias("code"),
    )
    cached = classify.CachedClassifier(spark, new_folder(spark, "answers"), model)
    ask = lambda df: cached.run(df, F.concat("rule_id", F.lit(": "), "code"), 100, [F.col("l_orderkey"), F.col("l_linenumber")])
    ask(f.where("l_orderkey % 2 = 0"))
    return ask(f).select("l_orderkey", "l_linenumber", "is_vulnerable", "final_severity", "final_confidence")
