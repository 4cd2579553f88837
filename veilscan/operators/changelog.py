"""Logs of changes folded over a table in the order of time.

A log may hold any number of changes of a key. Whether the key exists is a running state: the last
change before that made or ended it, else whether it is stored. A change that applies and makes or ends
the key starts a new life of it; a field is the last value set in the present life, else the stored one
(first life only), else its default. Everything is running maxima and last values over one partitioning
by key, so a log is shuffled by key and never gathered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Changes of a task, on average; it sorts them, each with the old and new values of its key.
TASK_CHANGES = 100_000


def tasks_for(changes: DataFrame) -> int:
    """Tasks that a log is dealt to by key. Left to sizes of the shuffle, which is narrow and compressed, a task
    would get millions of changes."""
    return max(1, math.ceil(changes.count() / TASK_CHANGES))


def folded(
    stored: DataFrame, changes: DataFrame, key: str, fields: Sequence[str], makes: Column, ends: Column,
    outcome: Callable[[Column], Column], asked: dict[str, Column], defaults: dict[str, Column],
    order: Sequence[str] = ("at",), tasks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(table after all ``changes``, the changes with ``outcome`` and the fields each leaves).

    ``makes`` and ``ends`` say which changes bring a key into being or remove it if they apply;
    ``outcome`` maps "the key exists just before" to the outcome, ``applied`` where the change takes
    effect; ``asked`` holds what a change sets, null where it leaves a field alone. A removal has the
    fields it removed. Changes with equal ``order`` follow one another by a hash of their contents. ``changes``
    that come dealt by key to a number of ``tasks`` stay there; else they are dealt here.
    """
    names = {f"_old_{f}": F.col(f) for f in fields}
    old = stored.select(F.col(key), F.lit(True).alias("_stored"), *[c.alias(n) for n, c in names.items()])
    if tasks is None:
        tasks = tasks_for(changes)
        changes = changes.repartition(tasks, key)
    log = changes.withColumn("_tie", F.xxhash64(*changes.columns)).withColumn("_makes", makes).withColumn("_ends", ends)
    log = log.withColumns({f"_asked_{f}": asked[f] for f in fields})
    log = log.join(old.repartition(tasks, key), key, "left").withColumn("_stored", F.coalesce("_stored", F.lit(False)))
    by_time = W.partitionBy(key).orderBy(*order, "_tie")
    earlier, until = by_time.rowsBetween(W.unboundedPreceding, -1), by_time.rowsBetween(W.unboundedPreceding, 0)
    switch = F.when(F.col("_makes"), True).when(F.col("_ends"), False)
    log = log.withColumns({
        "_exists": F.coalesce(F.last(switch, ignorenulls=True).over(earlier), F.col("_stored")),
        "_remains": F.coalesce(F.last(switch, ignorenulls=True).over(until), F.col("_stored")),
        "_next": F.lead(F.lit(1)).over(by_time),
    })
    log = log.withColumn("outcome", outcome(F.col("_exists"))).withColumn("_applied", F.col("outcome") == "applied")
    begun = F.sum((F.col("_applied") & F.col("_makes")).cast("int")).over(until)
    ended = F.coalesce(F.sum((F.col("_applied") & F.col("_ends")).cast("int")).over(earlier), F.lit(0))
    log = log.withColumn("_life", begun + ended).withColumn("_any", F.max("_applied").over(until))
    in_life = W.partitionBy(key, "_life").orderBy(*order, "_tie").rowsBetween(W.unboundedPreceding, 0)

    def value(f: str) -> Column:
        said = F.last(F.when(F.col("_applied"), F.col(f"_asked_{f}")), ignorenulls=True).over(in_life)
        # What a change that did not apply asked for is shown with it, and goes no further.
        own = F.when(~F.col("_applied"), F.col(f"_asked_{f}"))
        return F.coalesce(own, said, F.when(F.col("_life") == 0, F.col(f"_old_{f}")), defaults.get(f, F.lit(None)))

    def state(f: str) -> Column:
        said = F.last(F.when(F.col("_applied"), F.col(f"_asked_{f}")), ignorenulls=True).over(in_life)
        return F.coalesce(said, F.when(F.col("_life") == 0, F.col(f"_old_{f}")), defaults.get(f, F.lit(None)))

    rest = [c for c in changes.columns if c not in fields and c != key]
    done = log.select(
        key, *rest, "outcome", *[value(f).alias(f) for f in fields], *[state(f).alias(f"_state_{f}") for f in fields],
        (F.col("_next").isNull() & F.col("_any")).alias("_last"), "_remains",
    )
    last = done.filter("_last")
    after = stored.select(key, *fields).join(last.select(key), key, "left_anti").unionByName(
        last.filter("_remains").select(key, *[F.col(f"_state_{f}").alias(f) for f in fields]))
    return after, done.select(key, *rest, "outcome", *fields)
