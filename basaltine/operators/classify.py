"""Static classification of findings, and the hook for another classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basaltine.functions.scoring import CONFIDENCE, combine, lookup
from basaltine.session import written


@dataclass(frozen=True)
class Evidence:
    """What makes a finding of some rules harmless: its code has all of needs and none of unless. No rules: any rule."""

    note: str
    rules: tuple[str, ...]
    needs: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()


#: Rule ids are fixed values; the patterns are our own.
DISCOVERY = "PATH_DISCOVERY"
QUERIES = ("SQL_INJECTION", "NOSQL_INJECTION", "BROKEN_ACCESS_CONTROL", DISCOVERY)
COMMANDS = ("COMMAND_INJECTION", "CODE_INJECTION", DISCOVERY)
ACCESS = ("BROKEN_ACCESS_CONTROL", "INPUT_VALIDATION_MISSING", "IDOR", DISCOVERY)
MARKUP = ("XSS", "TEMPLATE_INJECTION")
REQUESTS = ("SSRF", "UNVALIDATED_REDIRECT", "OPEN_REDIRECT", DISCOVERY)
RANDOM = ("INSECURE_RANDOM", "OTP_INSECURE_RANDOM", "WEAK_RANDOM")
EXPRESSIONS = ("REGEX_DOS", "REDOS", DISCOVERY)
USES_REGEX = r"\bre\.(compile|match|search|fullmatch)\(|\bnew RegExp\(|/\.test\("
NESTED = r"\([^()]*[+*][^()]*\)[+*{]"
TOUCHES_FILES = r"\b(open|read_text|read_bytes|write_text|send_file|send_from_directory|sendFile|unlink|rmtree|readFile(Sync)?|writeFile(Sync)?|createReadStream)\("
SAFE = [
    Evidence("a parser that expands no entities", (), (r"\bdefusedxml\b",)),
    Evidence("entities are switched off", (DISCOVERY,), (r"(?i)\b(noent|resolve_?entities)\b\s*[:=]\s*false",)),
    Evidence("values beside a statement with places for them", QUERIES, (r"[\"'`][^\"'`\n]*(\?|%s|%\(\w+\)s|:\w+|\$\d)[^\"'`\n]*[\"'`]\s*,",)),
    Evidence("values beside a statement, in a list or record", QUERIES, (r"\b(execute|executemany|query|raw)\(\s*[^()]*,\s*[\[({]",)),
    Evidence("bound parameters", QUERIES, (r"\b(bindparam|bind_param|bindValue|setString|setInt)\(",)),
    Evidence("columns compared by the mapper", QUERIES, (r"\.(filter|where)\(\s*\w+\.\w+\s*==",)),
    Evidence("only strings reach the store", ("NOSQL_INJECTION", DISCOVERY), (r"typeof\s+[\w.]+\s*[!=]==?\s*['\"]string|\b(String|str|int)\(\s*req(uest)?\.",)),
    Evidence("arguments as a list, without a shell", COMMANDS, (r"\b(subprocess\.\w+|Popen|execFile(Sync)?|spawn(Sync)?)\(\s*(['\"][^'\"]*['\"]\s*,\s*)?\[",), (r"\bshell\s*[:=]\s*[Tt]rue",)),
    Evidence("words quoted for the shell", COMMANDS, (r"\bshlex\.(quote|join)\(",)),
    Evidence("an expression is compiled, not code", ("CODE_INJECTION",), (r"\bre\.compile\(",)),
    Evidence("no file is touched", ("PATH_TRAVERSAL",), (), (TOUCHES_FILES,)),
    Evidence("a path held under a root", ("PATH_TRAVERSAL",), (r"\b(startswith|startsWith|is_relative_to|commonpath)\(",)),
    Evidence("a name made harmless", ("PATH_TRAVERSAL",), (r"\b(secure_filename|basename)\(",)),
    Evidence("a file sent from a root", ("PATH_TRAVERSAL",), (r"\bsendFile\([^)]*\broot\b|\bsend_from_directory\(",)),
    Evidence("leading parts of a path taken off", ("PATH_TRAVERSAL",), (r"\bnormalize\([^)]*\)\s*\.replace\(",)),
    Evidence("an owner is compared", ACCESS, (r"(?i)\bowner_?id\b\s*[:=!]|\bcurrent_user\b|\buser_?id\s*!=",)),
    Evidence("a role is compared", ACCESS, (r"\.role\s*[!=]==?|\breq\.user\.\w+\s*[!=]==?",)),
    Evidence("a loader that builds plain values", (DISCOVERY,), (r"\bSafeLoader\b|\bsafe_load\(",)),
    Evidence("flags of a cookie are set", (DISCOVERY,), (r"(?i)\b(secure|http_?only)\b\s*[:=]\s*true",)),
    Evidence("a secret from the environment", (DISCOVERY,), (r"\bprocess\.env\.\w|\bos\.environ\b",)),
    Evidence("a name is logged, no password", (DISCOVERY,), (r"(?i)\blog(ger|ging)?\.\w+\([^)]*\busername\b",), (r"(?i)\blog(ger|ging)?\.\w+\([^)]*\bpassword\b",)),
    Evidence("no quantifier within a quantified group", EXPRESSIONS, (USES_REGEX,), (NESTED,)),
    Evidence("a template of the application's own", MARKUP, (r"\brender(_template)?\(\s*(request\s*,\s*)?['\"]",), (r"\brender_template_string\(",)),
    Evidence("text is escaped", MARKUP, (r"\b(html\.escape|escapeHtml|escape|markupsafe|bleach\.clean|DOMPurify\.sanitize|encodeURIComponent)\b",)),
    Evidence("text is set as text", MARKUP, (r"\.(textContent|innerText)\s*=|\.text\(",), (r"\.(innerHTML|outerHTML)\s*=|document\.write\(",)),
    Evidence("the answer is plain text", MARKUP, (r"(?i)text/plain",)),
    Evidence("a list of what is allowed", REQUESTS, (r"(?i)\b(allow|white|safe|trusted|permitted)(ed)?_?-?(list|hosts?|domains?|urls?|origins?)\b",)),
    Evidence("a request to the own host", ("SSRF",), (r"\b(fetch|axios\.\w+|\$\.(get|post|ajax))\(\s*[\"'`]/(?!/)",), (r"https?://|\bnew URL\(",)),
    Evidence("chance for the eye", RANDOM, (r"(?i)jitter|colou?r|anim|shuffle|particle|opacity|position|offset",), (r"(?i)\b\w*(token|session|password|secret|nonce|csrf|api_?key|otp|filename|verification|recovery)\w*\b",)),
]
#: A static result's confidence by the finding's word; which findings a model sees first; rules whose match is the whole verdict.
STATIC_CONFIDENCE = {"high": 0.85, "medium": 0.65, "low": 0.45, "critical": 0.90}
CONFIDENCE_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
PRESENCE = [
    "INSECURE_DESERIALIZATION", "WEAK_CRYPTO", "USE_OF_HARD_CODED_IV", "DEBUG_MODE_ENABLED", "DISABLED_CERTIFICATE_VALIDATION", "JWT_NONE_ALGORITHM",
    "JWT_WEAK_SECRET", "HARDCODED_SECRETS", "LOGGING_DISABLED", "AWS_METADATA_ACCESS", "GCP_METADATA_ACCESS", "AZURE_METADATA_ACCESS", "IMDS_TOKENLESS",
    "A06_NPM_RESOLVED_HTTP", "A06_NPM_REGISTRY_HTTP", "A06_PYTHON_VCS_DEP", "A06_PIPFILE_VCS", "VULNERABLE_COMPONENTS", "INSECURE_WEBSOCKET",
    "SECRET_QUESTIONS_PRESENT", "SESSION_VERIFICATION_BYPASSED", "JWT_EXP_NBF_NOT_VERIFIED", "JWT_HEADER_SOURCE_NOT_VALIDATED", "PASSWORD_FIELD_NOT_MASKED",
    "WEAK_PASSWORD_MIN_LENGTH", "OVERLY_RESTRICTIVE_PASSWORD_COMPOSITION", "PASSWORD_MANAGER_BLOCKED", "PASSWORD_MODIFIED_BEFORE_VERIFY", "STATIC_SESSION_SECRET",
]
#: Fixed value: what marks a finding that no model has confirmed.
UNCONFIRMED = "static analysis only"


def is_safe(rule: Column, code: Column) -> Column:
    """Whether some evidence speaks for a finding of a rule."""
    out = F.lit(False)
    for e in SAFE:
        hit = rule.isin(*e.rules) if e.rules else F.lit(True)
        for p in e.needs:
            hit = hit & code.rlike(p)
        for p in e.unless:
            hit = hit & ~code.rlike(p)
        out = out | hit
    return out


def static_confidence(confidence: Column) -> Column:
    return lookup(STATIC_CONFIDENCE, F.lower(F.coalesce(confidence, F.lit(""))), 0.65)


def static(findings: DataFrame) -> DataFrame:
    """findings (rule_id, confidence, code) with classification, final_confidence, explanation: vulnerable, unless some evidence speaks for them."""
    safe = is_safe(F.col("rule_id"), F.coalesce("code", F.lit("")))
    return findings.select(
        "*",
        F.when(safe, "SAFE").otherwise("VULNERABLE").alias("classification"),
        F.when(safe, 0.9).otherwise(static_confidence(F.col("confidence"))).alias("final_confidence"),
        F.lit(UNCONFIRMED).alias("explanation"),
    )


def with_budget(findings: DataFrame, per_scan: int, order: list[Column]) -> DataFrame:
    """Marks the first per_scan findings of each scan as those a model may see: by falling confidence word, then by order. Patterns that are the whole verdict never are."""
    whole = (F.upper("pattern_type") == "REGEX") & F.col("rule_id").isin(PRESENCE)
    alone = F.coalesce(whole, F.lit(False))
    sure = lookup(CONFIDENCE_RANK, F.lower(F.coalesce("confidence", F.lit(""))), 0)
    rank = F.row_number().over(Window.partitionBy("scan_id", alone).orderBy(-sure, *order))
    return findings.withColumn("for_model", (rank <= per_scan) & ~alone)


def classified_by(findings: DataFrame, classify: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Another classifier, called with whole batches. Its errors fall back on likely vulnerable, 0.5."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                yield classify(b)
            except Exception:  # noqa: BLE001  an outage of a remote service must not lose findings
                yield b.assign(classification="LIKELY_VULNERABLE", final_confidence=0.5, explanation="classifier unavailable")

    return findings.mapInPandas(run, schema)


ANSWER = "classification string, severity string, confidence double, explanation string"


class CachedClassifier:
    """A model whose answers are kept in a table by the hash of the prompt.

    A run asks only for prompts that the table lacks, each once however many findings share it, and adds the answers. Prompts that
    the model did not answer (null, or an error of the whole batch) are not kept, so the next run asks again; their
    findings, those beyond the budget and those without code get the static result. model: prompts to answers, a frame of
    the columns of ANSWER with a row for each prompt.
    """

    def __init__(self, spark: SparkSession, path: str, model: Callable[[pd.Series], pd.DataFrame], batch: int = 64):
        self.spark, self.path, self.model, self.batch = spark, path, model, batch
        self.asked = 0

    def _known(self) -> DataFrame:
        sc = self.spark.sparkContext
        done = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        schema = f"prompt_hash string, {ANSWER}"
        if done.getFileSystem(sc._jsc.hadoopConfiguration()).exists(done):
            return self.spark.read.schema(schema).parquet(self.path)
        return self.spark.createDataFrame([], schema)

    def _answers(self, prompts: DataFrame) -> DataFrame:
        model, batch = self.model, self.batch
        columns = [c.split()[0] for c in ANSWER.split(", ")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for at in range(0, len(b), batch):
                    part = b.iloc[at : at + batch].reset_index(drop=True)
                    try:
                        out = model(part["prompt"]).reset_index(drop=True)
                    except Exception:  # noqa: BLE001  an outage: nothing is kept, the next run asks again
                        continue
                    out = pd.concat([part[["prompt_hash"]], out[columns]], axis=1)
                    yield out[out["classification"].notna()]

        return prompts.mapInPandas(run, f"prompt_hash string, {ANSWER}")

    def run(self, findings: DataFrame, prompt: Column, per_scan: int = 100, order: list[Column] | None = None) -> DataFrame:
        """findings (scan_id, rule_id, severity, confidence, pattern_type, code, ...) with is_vulnerable, final_severity, final_confidence, explanation."""
        code = F.coalesce("code", F.lit(""))
        marked = with_budget(findings, per_scan, order or [F.col("rule_id"), code]).withColumn("prompt", F.when(F.trim(code) != "", prompt))
        marked = written(marked.withColumn("prompt_hash", F.when(F.col("for_model"), F.sha2("prompt", 256))), "classify")
        wanted = marked.where("prompt_hash is not null").groupBy("prompt_hash").agg(F.first("prompt").alias("prompt"))
        missing = written(wanted.join(self._known().select("prompt_hash"), "prompt_hash", "left_anti"), "prompts")
        self.asked = missing.count()
        if self.asked:
            self._answers(missing).write.mode("append").parquet(self.path)
        answers = self._known().select("prompt_hash", *[F.col(c.split()[0]).alias(f"model_{c.split()[0]}") for c in ANSWER.split(", ")])
        met = marked.join(answers, "prompt_hash", "left")
        answered, safe = F.col("model_classification").isNotNull(), is_safe(F.col("rule_id"), code)
        said = F.when(safe, "SAFE").when(answered, F.col("model_classification")).otherwise("VULNERABLE")
        model_severity = F.when(answered, F.col("model_severity")).otherwise(F.col("severity"))
        model_sure = F.when(answered, F.col("model_confidence")).otherwise(static_confidence(F.col("confidence")))
        static_sure = lookup(CONFIDENCE, F.lower(F.coalesce("confidence", F.lit(""))), 0.5)
        vulnerable, severity, sure = combine(F.lit("VULNERABLE"), said, F.col("severity"), model_severity, static_sure, model_sure)
        return met.select(
            *findings.columns,
            vulnerable.alias("is_vulnerable"),
            severity.alias("final_severity"),
            sure.alias("final_confidence"),
            F.when(safe, "evidence against it").when(answered, F.col("model_explanation")).otherwise(UNCONFIRMED).alias("explanation"),
        )
