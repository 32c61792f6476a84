"""Checks of configuration files.

Files of directives are parsed once into rows (name, value, context, line); a check is a condition on one row that makes
it good or bad, or a set of names that must all be there. JSON documents are read by their structure. Other files (YAML, Terraform) are
checked by patterns on their text. Each check says what absence means.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltine.functions.text import first_line_of
from basaltine.operators import policies
from basaltine.sources.directives import with_directives

Row = Callable[[Column], Column]


@dataclass(frozen=True)
class Setting:
    """verdict: a bad row -> fail; a good one -> pass; neither -> absent (None: no row). only: where such a row is found."""

    control: str
    kind: str
    good: Row
    bad: Row | None = None
    absent: str | None = "fail"
    only: Row | None = None
    every: int = 0  # so many different names of good rows make a pass, if set
    sure: float = 0.8
    unsure: float = 0.55
    note: str = ""


@dataclass(frozen=True)
class Check:
    """The same by patterns on the text. gate: only where this is found."""

    control: str
    kind: str
    good: str | None
    bad: str | None = None
    absent: str | None = "fail"
    gate: str | None = None
    sure: float = 0.8
    unsure: float = 0.55
    note: str = ""


YEAR = 31_536_000


def named(*names: str) -> Row:
    return lambda d: d["name"].isin(*names)


def valued(name: str, *words: str) -> Row:
    """A directive one of whose arguments is one of the words."""
    return lambda d: (d["name"] == name) & F.arrays_overlap(F.split(F.lower(d["value"]), r"\s+"), F.array(*[F.lit(w) for w in words]))


def header(name: str, good: Callable[[Column], Column]) -> Row:
    """A response header whose value, in lower case, is good."""
    rest = lambda d: F.trim(F.substr(F.lower(d["value"]), F.lit(len(name) + 2)))
    return lambda d: (d["name"] == "add_header") & F.startswith(F.lower(d["value"]), F.lit(f"{name} ")) & good(rest(d))


def policy(*parts: str) -> Row:
    """A content security policy that has all of the parts."""

    def has(value: Column) -> Column:
        out = F.lit(True)
        for p in parts:
            out = out & F.contains(value, F.lit(p))
        return out

    return header("content-security-policy", has)


def age(value: Column) -> Column:
    """The seconds of max-age; null without."""
    return F.try_to_number(F.nullif(F.split_part(F.split_part(value, F.lit("max-age="), F.lit(2)), F.lit(";"), F.lit(1)), F.lit("")), F.lit("999999999999")).cast("long")


def within(*words: str, row: Row = lambda d: F.lit(True)) -> Row:
    """A row inside a location whose header has one of the words."""

    def inside(d: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(d["context"], F.lit(w))
        return F.contains(d["context"], F.lit("location")) & out & row(d)

    return inside


def location(*words: str) -> Row:
    def opened(d: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(F.lower(d["value"]), F.lit(w))
        return (d["name"] == "location") & out

    return opened


def weak_ciphers(d: Column) -> Column:
    """A weak family among the ciphers of a list, unless it is excluded by a sign in front."""
    weak = F.array(*[F.lit(x) for x in ("RC4", "3DES", "DES", "MD5", "NULL", "EXPORT", "DES-CBC3")])
    offered = F.filter(F.split(F.upper(d["value"]), r"[:,\s]+"), lambda c: ~F.substring(c, 1, 1).isin("!", "-"))
    return F.exists(offered, lambda c: F.arrays_overlap(F.split(c, r"[-+]"), weak))


def either(*rows: Row) -> Row:
    def any_of(d: Column) -> Column:
        out = F.lit(False)
        for r in rows:
            out = out | r(d)
        return out

    return any_of


API, UPLOAD, PRIVATE = ("/api", "/graphql", "/rpc"), ("upload",), ("account", "profile", "admin")
LIMITS = ("max_upload_size", "max_content_length", "max_body_size")
#: Control ids, file kinds and confidences are fixed values.
SETTINGS = [
    Setting("V3.4.1", "nginx", header("strict-transport-security", lambda v: age(v) >= YEAR), header("strict-transport-security", lambda v: age(v) < YEAR), sure=0.85, unsure=0.6, note="HSTS for a year"),
    Setting("V4.1.1", "nginx", named("charset"), sure=0.6, unsure=0.4, note="charset"),
    Setting("V4.1.2", "nginx", location(*API), within(*API, row=lambda d: (d["name"] == "return") & F.startswith(d["value"], F.lit("301 https"))), None, sure=0.5, note="no redirect of API calls"),
    Setting("V5.2.1", "nginx", named("client_max_body_size"), sure=0.85, unsure=0.5, note="body size"),
    Setting("V3.4.4", "nginx", header("x-content-type-options", lambda v: F.startswith(v, F.lit("nosniff"))), note="nosniff"),
    Setting("V3.4.5", "nginx", header("referrer-policy", lambda v: v != ""), note="referrer policy"),
    Setting("V3.4.6", "nginx", policy("frame-ancestors"), note="frame ancestors"),
    Setting("V3.4.7", "nginx", either(policy("report-uri"), policy("report-to")), note="report endpoint"),
    Setting("V3.4.8", "nginx", header("cross-origin-opener-policy", lambda v: F.startswith(v, F.lit("same-origin"))), note="opener policy"),
    Setting("V3.5.8", "nginx", header("cross-origin-resource-policy", lambda v: F.startswith(v, F.lit("same-"))), note="resource policy"),
    Setting("V3.4.3", "nginx", policy("default-src", "object-src", "base-uri"), note="three CSP directives"),
    Setting("V3.2.1", "nginx", within(*UPLOAD, row=either(lambda d: F.contains(F.lower(d["value"]), F.lit("content-disposition")), lambda d: F.contains(F.lower(d["value"]), F.lit("sandbox")))), None, "fail", location(*UPLOAD), note="uploads as attachments"),
    Setting("V5.3.1", "nginx", within(*UPLOAD, row=valued("deny", "all")), within(*UPLOAD, row=named("fastcgi_pass", "proxy_pass")), "fail", location(*UPLOAD), note="no scripts in uploads"),
    Setting("V13.4.3", "nginx", valued("autoindex", "off"), valued("autoindex", "on"), "pass", unsure=0.4, note="no directory listing"),
    Setting("V13.4.4", "nginx", either(named("limit_except"), lambda d: F.contains(d["value"], F.lit("request_method")) & F.contains(d["value"], F.lit("TRACE"))), None, None, note="TRACE blocked"),
    Setting("V4.1.4", "nginx", either(named("limit_except"), lambda d: F.contains(d["value"], F.lit("request_method")) & F.contains(d["value"], F.lit("!~"))), note="allowed methods"),
    Setting("V12.1.2", "nginx", named("ssl_ciphers"), lambda d: (d["name"] == "ssl_ciphers") & weak_ciphers(d), None, note="no weak ciphers"),
    Setting("V14.3.2", "nginx", within(*PRIVATE, row=lambda d: F.contains(F.lower(d["value"]), F.lit("no-store"))), None, "fail", location(*PRIVATE), note="no-store"),
    Setting("V14.2.5", "nginx", within(*PRIVATE, row=named("proxy_cache_bypass")), None, "fail", location(*PRIVATE), note="cache bypass"),
    Setting("V12.1.4", "nginx", valued("ssl_stapling", "on"), note="OCSP stapling"),
    Setting("V12.1.5", "nginx", named("ssl_ech", "encrypted_client_hello"), None, None, note="encrypted client hello"),
    Setting("V13.4.6", "nginx", valued("server_tokens", "off"), valued("server_tokens", "on"), None, note="version hidden"),
    Setting("V13.4.7", "nginx", lambda d: (d["name"] == "location") & F.startswith(d["value"], F.lit("~")) & F.contains(d["value"], F.lit("\\.(")), None, None, note="allowed extensions"),
    Setting("V13.2.5", "nginx", lambda d: (d["name"] == "allow") & F.contains(d["context"], F.lit("location")), None, None, named("proxy_pass"), note="egress rules"),
    Setting("V5.2.1", "env", named(*LIMITS), None, None, note="body size"),
    Setting("V5.2.1", "dockerfile", named(*LIMITS), None, None, note="body size"),
    Setting("V17.1.1", "coturn", named("denied-peer-ip", "allowed-peer-ip"), note="relay ranges"),
    Setting("V17.1.2", "coturn", named("min-port", "max-port", "user-quota", "total-quota"), every=3, note="port and quota bounds"),
    Setting("V17.2.2", "coturn", named("cipher-list"), lambda d: (d["name"] == "cipher-list") & weak_ciphers(d), None, note="cipher list"),
]
#: The rows for other files; patterns are Java regular expressions.
CHECKS = [
    Check("V13.2.5", "yaml", r"(?is)kind:\s*NetworkPolicy.*policyTypes:[^a-z]*(.*-\s*)?Egress", None, None, r"(?i)kind:\s*NetworkPolicy", note="egress policy"),
    Check("V12.3.5", "yaml", r"(?is)kind:\s*PeerAuthentication.*mode:\s*STRICT", r"(?is)kind:\s*PeerAuthentication.*mode:\s*(PERMISSIVE|DISABLE)", None, note="strict mTLS"),
    Check("V16.4.2", "yaml", r"(?is)kind:\s*(Cluster)?Role\b.*resources:", r"(?is)kind:\s*(Cluster)?Role\b.*(verbs|resources):\s*\[\s*[\"']\*", None, note="no wildcard roles"),
    Check("V5.2.1", "yaml", r"(?i)(max_body_size|maxFileSize|max-request-size)\s*:\s*\S+", None, None, note="body size"),
    Check("V3.4.1", "yaml", r"(?i)(hsts_max_age|hsts-max-age)\s*:\s*[\"']?(3153[6-9]\d{3}|3[2-9]\d{6}|[4-9]\d{7}|\d{9,})", r"(?i)(hsts_max_age|hsts-max-age)\s*:\s*[\"']?\d+", None, note="HSTS for a year"),
    Check("V13.2.2", "terraform", r"(?i)actions?\s*=\s*\[", r"(?i)(actions?|resources?)\s*=\s*\[\s*\"\*\"", None, note="no wildcard"),
    Check("V13.3.4", "terraform", r"(?is)aws_secretsmanager_secret_rotation.*automatically_after_days\s*=\s*\d+", None, "fail", r"(?i)aws_secretsmanager_secret\"", note="rotation"),
]


def kind_of(name: Column, content: Column) -> Column:
    """What a file configures; the first that fits. name in lower case."""
    return (
        F.when(name.startswith(".env"), "env")
        .when(name.startswith("dockerfile"), "dockerfile")
        .when(content.rlike(r"(?im)^\s*(listening-port|realm|denied-peer-ip|min-port)\s*="), "coturn")
        .when(name.contains("nginx") | (name.endswith(".conf") & content.rlike(r"(?i)server\s*\{|location\s+")), "nginx")
        .when(name.rlike(r"\.ya?ml$"), "yaml")
        .when(name.endswith(".tf"), "terraform")
        .when(name.endswith(".json") & content.rlike(r"\"Statement\"\s*:"), "iam")
        .when(name.endswith(".json") & content.rlike(r"\"RotationEnabled\"\s*:"), "secrets")
    )


def _row(control: str, verdict: Column, line: Column, note: str, sure: float, unsure: float, found: Column) -> Column:
    return F.struct(
        F.lit(control).alias("control_id"),
        verdict.alias("verdict"),
        line.cast("long").alias("line"),
        F.lit(note).alias("note"),
        F.when(found, sure).otherwise(unsure).alias("confidence"),
    )


def _setting(c: Setting, kind: Column, rows: Column) -> Column:
    gate = kind == c.kind
    if c.only:
        gate = gate & F.exists(rows, c.only)
    good = F.filter(rows, c.good)
    bad = F.filter(rows, c.bad) if c.bad else F.filter(rows, lambda d: F.lit(False))
    enough = F.size(F.array_distinct(F.transform(good, lambda d: d["name"]))) >= max(c.every, 1)
    verdict = F.when(F.size(bad) > 0, "fail").when(enough, "pass")
    found = verdict.isNotNull()
    verdict = F.coalesce(verdict, F.lit(c.absent))
    line = F.when(F.size(bad) > 0, F.get(bad, 0)["line"]).when(found, F.get(good, 0)["line"])
    return F.when(gate & verdict.isNotNull(), _row(c.control, verdict, line, c.note, c.sure, c.unsure, found))


def _check(c: Check, kind: Column, text: Column) -> Column:
    # a YAML file holds several documents; a pattern has to fit within one
    parts = F.split(text, r"(?m)^---[ \t]*\r?$") if c.kind == "yaml" else F.array(text)

    def fits(pattern: str | None) -> Column:
        return F.exists(parts, lambda d: d.rlike(pattern)) if pattern else F.lit(False)

    gate = (kind == c.kind) & (fits(c.gate) if c.gate else F.lit(True))
    good, bad = fits(c.good), fits(c.bad)
    strict = c.control == "V3.4.1"  # there good is a part of bad: a long enough age
    verdict = F.when(good, "pass").when(bad, "fail") if strict else F.when(bad, "fail").when(good, "pass")
    found = verdict.isNotNull()
    verdict = F.coalesce(verdict, F.lit(c.absent))
    pattern = F.when(bad & (verdict == "fail"), F.lit(c.bad)).otherwise(F.lit(c.good))
    line = F.when(found, F.nullif(first_line_of(text, pattern), F.lit(0)))
    return F.when(gate & verdict.isNotNull(), _row(c.control, verdict, line, c.note, c.sure, c.unsure, found))


def _documents(kind: Column, text: Column) -> list[Column]:
    """The rows of JSON documents."""
    statements = policies.allowed_statements(text)
    said = {c: F.when(kind == "iam", policies.policy_verdict(statements, c)) for c in (policies.GENERAL, *policies.ABOUT)}
    nowhere = F.lit(None).cast("long")
    out = [F.when(v.isNotNull(), _row(c, v, nowhere, "access granted", 0.6, 0.4, v == "fail")) for c, v in said.items()]
    rotated = F.when(kind == "secrets", policies.rotation_verdict(text))
    return [*out, F.when(rotated.isNotNull(), _row(policies.ROTATION, rotated, nowhere, "rotation", 0.6, 0.55, rotated == "pass"))]


def inspect(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """files' other columns with control_id, verdict, line, note, confidence: a row for each check that says something."""
    kept = [c for c in files.columns if c != content]
    marked = files.withColumn("__kind", kind_of(F.col(name), F.col(content))).where("__kind is not null")
    marked = with_directives(marked, "__kind", content, "__rows")
    said = [_setting(c, F.col("__kind"), F.col("__rows")) for c in SETTINGS] + [_check(c, F.col("__kind"), F.col(content)) for c in CHECKS]
    said += _documents(F.col("__kind"), F.col(content))
    return marked.select(*kept, F.inline(F.array_compact(F.array(*said))))


def registry_pins(files: DataFrame) -> DataFrame:
    """(repo_id, control_id, verdict, scopes): scoped packages whose registry no .npmrc of the repository names."""
    scope = F.array_distinct(F.regexp_extract_all("content", F.lit(r"\"(@[a-z0-9-]+)/"), F.lit(1)))
    used = files.where("name = 'package.json'").select("repo_id", F.explode(scope).alias("scope")).distinct()
    rc = files.where("name = '.npmrc'")
    pinned = rc.select("repo_id", F.explode(F.regexp_extract_all("content", F.lit(r"(@[a-z0-9-]+):registry *="), F.lit(1))).alias("scope"))
    whole = rc.where(F.col("content").rlike(r"(?m)^\s*registry\s*=")).select("repo_id").distinct().withColumn("whole", F.lit(True))
    open_ = used.join(pinned.distinct(), ["repo_id", "scope"], "left_anti").join(whole, "repo_id", "left").where("whole is null")
    missing = open_.groupBy("repo_id").agg(F.array_sort(F.collect_set("scope")).alias("scopes"))
    out = used.select("repo_id").distinct().join(missing, "repo_id", "left")
    verdict = F.when(F.col("scopes").isNull(), "pass").otherwise("fail")
    return out.select("repo_id", F.lit("V15.2.4").alias("control_id"), verdict.alias("verdict"), "scopes")
