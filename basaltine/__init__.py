"""basaltine: a Spark-first analytics engine for code-security data."""

__version__ = "0.1.0"
