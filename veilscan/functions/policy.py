"""Policy fields and modes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.constants import ACTION_RANK, DEFAULT_POLICY, FAIL_MODES, POLICY_MODES


def mode_of(deep_scan_required: Column, on_unreadable: Column) -> Column:
    """Name of the mode two fields amount to; any other mix is custom."""
    out = F.lit("custom")
    for name, fields in POLICY_MODES.items():
        fits = (deep_scan_required == F.lit(fields["deep_scan_required"])) & (
            on_unreadable == F.lit(fields["on_unreadable"])
        )
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


def expand_mode(mode: Column, field: str, explicit: Column) -> Column:
    """Value a change asks for: its own field if given, else what its mode implies, else null."""
    implied = F.lit(None)
    for name, fields in POLICY_MODES.items():
        implied = F.when(mode == name, F.lit(fields[field])).otherwise(implied)
    return F.coalesce(explicit, implied)


def policy_faults(mode: Column, fail_mode: Column, on_unreadable: Column) -> Column:
    """What is wrong with a submitted policy, as array<string>; unset fields are fine."""
    return F.array_compact(
        F.array(
            F.when(mode.isNotNull() & ~mode.isin(*POLICY_MODES, "custom", ""), F.lit("mode")),
            F.when(fail_mode.isNotNull() & ~fail_mode.isin(*FAIL_MODES), F.lit("fail_mode")),
            F.when(on_unreadable.isNotNull() & ~on_unreadable.isin(*ACTION_RANK), F.lit("on_unreadable")),
        )
    )


def tags_or_all(tags: Column) -> Column:
    return F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, tags).otherwise(
        F.array(*[F.lit(t) for t in DEFAULT_POLICY["rule_tags"]])
    )
