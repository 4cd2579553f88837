"""Alert lines: CEF header and extensions, syslog prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and numbers of the alert format. Vendor and product are settings; the
# ones here are our own.
PRIORITY = 108
PROGRAM = "veilscan"
VENDOR, PRODUCT, VERSION = "Veilscan", "DocumentDLP", "1.0"
SIGNATURES = {
    "failed_open": ("INSPECTION_FAILED_OPEN", "Print job released without inspection"),
    "released_then_flagged": ("PRINT_FLAGGED_AFTER_RELEASE", "Sensitive document detected after it printed"),
    "blocked": ("PRINT_BLOCKED", "Print job blocked by DLP policy"),
    "held": ("PRINT_HELD", "Print job held for review"),
    "match": ("PRINT_POLICY_MATCH", "Sensitive data printed"),
    "clean": ("PRINT_CLEAN", "Print job inspected, no match"),
}
SEVERITY_FLOOR = {"released_then_flagged": 7, "blocked": 8, "held": 6}
FAILED_OPEN_SEVERITY, CLEAN_SEVERITY, UNKNOWN_SEVERITY = 7, 1, 5
KEYS = (
    "rt", "suser", "shost", "dproc", "fname", "fsize", "fileHash", "cs1", "cs1Label", "cs2", "cs2Label",
    "cs3", "cs3Label", "cs4", "cs4Label", "cn1", "cn1Label", "cn2", "cn2Label", "cn3", "cn3Label", "msg",
    "cs5", "cs5Label",
)
LABELS = {
    "cs1Label": "action", "cs2Label": "jobId", "cs3Label": "ruleIds", "cs4Label": "scanTier",
    "cn1Label": "matchCount", "cn2Label": "pageCount", "cn3Label": "inspectMs", "cs5Label": "maskedSample",
}


def escape_header(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def escape_extension(value: Column) -> Column:
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("="), F.lit("\\="))
    return F.translate(escaped, "\n\r", "  ")


def event_kind(state: Column, has_matches: Column) -> Column:
    return (
        F.when(state.isin("failed_open", "released_then_flagged", "blocked", "held"), state)
        .when(has_matches, "match").otherwise("clean")
    )


def signature(kind: Column, part: int) -> Column:
    out = F.lit(None).cast("string")
    for name, pair in SIGNATURES.items():
        out = F.when(kind == name, F.lit(pair[part])).otherwise(out)
    return out


def event_severity(kind: Column, top_severity: Column) -> Column:
    known = F.coalesce(top_severity, F.lit(UNKNOWN_SEVERITY))
    out = F.when(kind == "failed_open", F.lit(FAILED_OPEN_SEVERITY)).when(kind == "clean", F.lit(CLEAN_SEVERITY))
    for name, floor in SEVERITY_FLOOR.items():
        out = out.when(kind == name, F.greatest(known, F.lit(floor)))
    return out.otherwise(known)


def header(signature_id: Column, name: Column, severity: Column) -> Column:
    fixed = [F.lit("CEF:0"), *[escape_header(F.lit(v)) for v in (VENDOR, PRODUCT, VERSION)]]
    clamped = F.least(F.greatest(severity, F.lit(0)), F.lit(10)).cast("string")
    return F.concat_ws("|", *fixed, escape_header(signature_id), escape_header(name), clamped)


def extensions(values: dict[str, Column]) -> Column:
    """``key=value`` pairs in the given order; empty values are left out."""
    return F.concat_ws(
        " ",
        *[
            F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{key}="), escape_extension(value)))
            for key, value in values.items()
        ],
    )


def syslog_prefix(at: Column, host: Column) -> Column:
    return F.concat(
        F.lit(f"<{PRIORITY}>"), F.date_format(at, "MMM dd HH:mm:ss"), F.lit(" "), host, F.lit(f" {PROGRAM}: ")
    )
