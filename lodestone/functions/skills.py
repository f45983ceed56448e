"""Skill detection by a fixed, ordered catalogue of patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from re import _constants as constants
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

# Skill names and the patterns that show them, in order.
CATALOG = (
    ("Java", "java"),
    ("Python", "python"),
    ("Go", "golang"),
    ("JavaScript", "javascript"),
    ("TypeScript", "typescript"),
    ("C++", r"c\+\+"),
    ("C#", "c#|c sharp"),
    ("SQL", "sql"),
    ("Spring Boot", "spring(?: boot)?"),
    ("React", r"react(?:\.js)?"),
    ("Angular", "angular"),
    ("Node.js", r"node(?:\.js)?"),
    ("AWS", "aws|amazon web services"),
    ("Azure", "azure"),
    ("GCP", "gcp|google cloud"),
    ("Docker", "docker"),
    ("Kubernetes", r"kubernetes|\bk8s\b"),
    ("Terraform", "terraform"),
    ("Kafka", "kafka"),
    ("Redis", "redis"),
    ("PostgreSQL", "postgres(?:ql)?"),
    ("MySQL", "mysql"),
    ("MongoDB", "mongodb"),
    ("Elasticsearch", "elasticsearch|elastic search"),
    ("Spark", r"apache spark|\bspark\b"),
    ("Flink", "flink"),
    ("Airflow", "airflow"),
    ("Hadoop", "hadoop"),
    ("Snowflake", "snowflake"),
    ("Databricks", "databricks"),
    ("REST", "rest(?:ful)? api"),
    ("GraphQL", "graphql"),
    ("gRPC", "grpc"),
    ("Microservices", "microservices?"),
    ("Distributed Systems", "distributed systems?"),
    ("CI/CD", "ci/cd|continuous integration|continuous delivery"),
    ("Git", r"\bgit\b|github|gitlab"),
    ("Linux", "linux"),
    ("Machine Learning", r"machine learning|\bml\b"),
    ("LLM", r"large language model|\bllms?\b"),
    ("RAG", r"retrieval.augmented generation|\brag\b"),
    ("PyTorch", "pytorch"),
    ("TensorFlow", "tensorflow"),
    ("Pandas", "pandas"),
    ("NumPy", "numpy"),
)

# The catalogue's bare word "go" never matches (a boundary was mistyped in the
# behaviour this engine reproduces); this entry is the opt-in repair.
GO_REPAIRED = ("Go", r"golang|\bgo\b")

WORD = "A-Za-z0-9_"


def java_pattern(expression: str) -> str:
    """The whole test pattern, for Spark.

    Spark's engine takes word boundaries by Unicode, RE2 by ASCII; spelled
    out they are the same in both.
    """
    inner = re.sub(r"^\\b|(?<=\|)\\b", f"(?<![{WORD}])", expression)
    inner = inner.replace(r"\b", f"(?![{WORD}])")
    return f"(?:^|[^a-z0-9])(?:{inner})(?:$|[^a-z0-9])"


def re2_pattern(expression: str) -> str:
    """The same test for RE2, which has no look-around."""
    return f"(?:^|[^a-z0-9])(?:{expression})(?:$|[^a-z0-9])"


def literals(expression: str) -> list[str]:
    """A text that each alternative of a pattern can't match without."""
    out = []
    for alternative in re.split(r"(?<!\\)\|", expression):
        runs, now = [], ""
        for kind, arg in [*parser.parse(alternative), (None, None)]:
            if kind is constants.LITERAL:
                now += chr(arg)
            elif kind is not constants.AT:
                runs.append(now)
                now = ""
        out.append(max(runs, key=len))
    return out


def catalog(fix_go: bool = False) -> tuple[tuple[str, str], ...]:
    return tuple(GO_REPAIRED if fix_go and name == "Go" else (name, p) for name, p in CATALOG)


def detect(text: Column, entries: Sequence[tuple[str, str]] = CATALOG) -> Column:
    """Names of the catalogue entries that occur, in catalogue order.

    A plain search for what a pattern must contain goes before the pattern.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    there = lambda p: reduce(lambda x, y: x | y, (low.contains(t) for t in literals(p)))
    return F.array_compact(F.array(*(F.when(there(p) & low.rlike(java_pattern(p)), F.lit(name)) for name, p in entries)))


def to_json_list(skills: Column) -> Column:
    return F.coalesce(F.to_json(skills), F.lit("[]"))


def from_json_list(text: Column) -> Column:
    """JSON array text to an array; null or malformed text is an empty array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
