"""Detection rules as data: loading, validation, and the rules table."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.constants import ACTION_RANK, SEVERITY_MAX, SEVERITY_MIN
from veilscan.functions.checks import check_named
from veilscan.functions.dialect import problems, to_java
from veilscan.sources.shipped_rules import SHIPPED_RULES

# A rule table is configuration: it is read to the driver to plan the scan, so its size is
# checked first.

RULE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("validator", T.StringType()),
        T.StructField("validator_weight", T.DoubleType()),
        T.StructField("base_confidence", T.DoubleType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("min_count", T.IntegerType()),
        T.StructField("ignore_case", T.BooleanType()),
        T.StructField("sample_prefix", T.IntegerType()),
        T.StructField("sample_suffix", T.IntegerType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField(
            "context",
            T.StructType(
                [
                    T.StructField("terms", T.ArrayType(T.StringType())),
                    T.StructField("window", T.IntegerType()),
                    T.StructField("boost", T.DoubleType()),
                    T.StructField("required", T.BooleanType()),
                ]
            ),
        ),
        T.StructField(
            "fixtures",
            T.StructType(
                [
                    T.StructField("positive", T.ArrayType(T.StringType())),
                    T.StructField("negative", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField("enabled", T.BooleanType()),
    ]
)


class RuleError(ValueError):
    """A rule or a rule file cannot be used."""


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    pattern: str
    action: str = "log"
    severity: int = 5
    validator: str | None = None
    validator_weight: float = 0.3
    base_confidence: float = 0.6
    threshold: float = 0.75
    min_count: int = 1
    ignore_case: bool = True
    tags: tuple[str, ...] = ()
    enabled: bool = True
    description: str = ""
    terms: tuple[str, ...] = ()
    window: int = 50
    boost: float = 0.3
    required: bool = False
    positive: tuple[str, ...] = field(default=(), compare=False)
    negative: tuple[str, ...] = field(default=(), compare=False)
    sample_prefix: int = 4
    sample_suffix: int = 4


FLAT = {f for f in Rule.__dataclass_fields__} - {
    "terms", "window", "boost", "required", "positive", "negative"
}


def rule_from(entry: dict) -> Rule:
    """A rule from its nested form; parts that are missing or null take their defaults."""
    values = {k: v for k, v in entry.items() if k in FLAT and v is not None}
    for part, names in (("context", ("terms", "window", "boost", "required")),
                        ("fixtures", ("positive", "negative"))):
        inner = entry.get(part) or {}
        values.update({k: inner[k] for k in names if inner.get(k) is not None})
    for name in ("tags", "terms", "positive", "negative"):
        if name in values:
            values[name] = tuple(values[name])
    try:
        rule = Rule(**values)
    except TypeError as err:
        raise RuleError(f"rule {entry.get('id', '?')!r}: {err}") from err
    faults = rule_problems(rule)
    if faults:
        raise RuleError(f"rule {rule.id!r}: {'; '.join(faults)}")
    return rule


def java_fault(pattern: str) -> str | None:
    """What Java says against a rewritten pattern, if a session runs: such a rule must fail on loading,
    not in the tasks of a scan."""
    context = SparkContext._active_spark_context
    jvm = getattr(context, "_jvm", None)
    if jvm is None:
        return None
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except (IllegalArgumentException, Py4JJavaError) as err:
        return f"invalid regular expression: {str(err).splitlines()[0]}"
    return None


def rule_problems(rule: Rule) -> list[str]:
    faults = problems(rule.pattern)
    if not faults:
        fault = java_fault(to_java(rule.pattern, rule.ignore_case))
        faults = [fault] if fault else []
    if not SEVERITY_MIN <= rule.severity <= SEVERITY_MAX:
        faults.append(f"severity must be {SEVERITY_MIN}-{SEVERITY_MAX}")
    if rule.action not in ACTION_RANK:
        faults.append(f"action must be one of {', '.join(ACTION_RANK)}")
    try:
        check_named(rule.validator)
    except ValueError as err:
        faults.append(str(err))
    return faults


def active(rules: list[Rule]) -> list[Rule]:
    """Enabled rules in id order; two of one id are an error."""
    kept = sorted((r for r in rules if r.enabled), key=lambda r: r.id)
    twice = sorted({a.id for a, b in zip(kept, kept[1:]) if a.id == b.id})
    if twice:
        raise RuleError(f"duplicate rule ids: {twice}")
    return kept


def shipped_rules() -> list[Rule]:
    return active([rule_from(entry) for entry in SHIPPED_RULES])


def load_rules(directory: str) -> list[Rule]:
    """All ``*.yaml`` (and ``*.json``) packs of a folder, in name order. Any bad file or rule
    stops the load: a skipped file would be a control that is silently off."""
    folder = Path(directory)
    if not folder.is_dir():
        raise FileNotFoundError(f"rules directory not found: {folder}")
    entries = []
    for path in sorted([*folder.glob("*.yaml"), *folder.glob("*.json")]):
        try:
            content = _parse(path)
            listed = content.get("rules", []) if isinstance(content, dict) else content or []
            entries.extend(rule_from(entry) for entry in listed)
        except Exception as err:
            raise RuleError(f"{path.name}: {err}") from err
    return active(entries)


def rules_from_files(spark: SparkSession, folder: str) -> list[Rule]:
    """The same for a folder in any store that Spark reads; files of other endings than ``.yaml`` are JSON.
    Packs are written by people, so all of their text fits the driver."""
    files = spark.read.option("wholetext", True).text(folder).select(F.col("_metadata.file_name").alias("name"), "value")
    entries = []
    for name, text in sorted(tuple(r) for r in files.collect()):
        try:
            content = _parsed(text, name.endswith(".yaml"))
            listed = content.get("rules", []) if isinstance(content, dict) else content or []
            entries.extend(rule_from(entry) for entry in listed)
        except Exception as err:
            raise RuleError(f"{name}: {err}") from err
    return active(entries)


def _parse(path: Path):
    return _parsed(path.read_text(encoding="utf-8"), path.suffix == ".yaml")


def _parsed(text: str, is_yaml: bool):
    if not is_yaml:
        return json.loads(text)
    try:
        import yaml
    except ImportError as err:
        raise RuleError("PyYAML is needed for .yaml packs; JSON packs work without it") from err
    return yaml.safe_load(text)


def nested(rule: Rule) -> dict:
    """The nested form of a rule, as stored in the rules table."""
    out = {name: getattr(rule, name) for name in FLAT}
    out["tags"] = list(rule.tags)
    out["context"] = {
        "terms": list(rule.terms), "window": rule.window,
        "boost": rule.boost, "required": rule.required,
    }
    out["fixtures"] = {"positive": list(rule.positive), "negative": list(rule.negative)}
    return out


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [tuple(nested(r)[f] for f in RULE_SCHEMA.fieldNames()) for r in rules]
    return spark.createDataFrame(
        [tuple(_as_row(v) for v in row) for row in rows], RULE_SCHEMA
    )


def _as_row(value):
    return tuple(value.values()) if isinstance(value, dict) else value


def rules_from_table(table: DataFrame) -> list[Rule]:
    """Rules of a table, read to the driver to plan a scan with literal patterns."""
    rows = table.filter(F.col("enabled")).collect()
    return active([rule_from(row.asDict(recursive=True)) for row in rows])


def duplicate_ids(table: DataFrame) -> DataFrame:
    """Ids that more than one enabled rule uses."""
    return (
        table.filter(F.coalesce(F.col("enabled"), F.lit(True)))
        .groupBy("id")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
    )
