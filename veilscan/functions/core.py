"""Small building blocks for column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.constants import ACTION_RANK, STATE_OF_ACTION

# Characters counted as white space at the ends of a text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``.

    A lambda variable is bound to the evaluated value, whereas a plain column expression
    would be computed again for every use and for every element of an inner loop.
    """
    return F.transform(F.array(value), body).getItem(0)


def unnest(df: DataFrame, computed: Column, name: str, keep: Sequence[str]) -> DataFrame:
    """One row per element of a costly computed array.

    A plain ``explode`` makes the optimizer add a not-empty filter on the array, which copies
    the whole computation below the scan. The outer form has no such filter; the null row of
    an empty array is dropped after it.
    """
    return df.select(*keep, F.explode_outer(computed).alias(name)).filter(F.col(name).isNotNull())


def chars(value: Column) -> Column:
    return F.split(value, "")


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def one_of(value: Column, mapping: dict, default=None) -> Column:
    """Look ``value`` up in a small literal mapping."""
    out = F.lit(default)
    for key, result in mapping.items():
        out = F.when(value == F.lit(key), F.lit(result)).otherwise(out)
    return out


def action_rank(action: Column) -> Column:
    return one_of(action, ACTION_RANK)


def action_of_rank(rank: Column) -> Column:
    return one_of(rank, {v: k for k, v in ACTION_RANK.items()})


def state_of_action(action: Column) -> Column:
    return one_of(action, STATE_OF_ACTION)


def releasable(action: Column) -> Column:
    return action.isin("allow", "log")


def two_decimals(score: Column) -> Column:
    """Half-even two-decimal text of a score."""
    return F.format_string("%.2f", F.bround(score, 2))
