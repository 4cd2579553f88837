"""Reading tables and writing intermediate ones, for all operators of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.session import persist_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read again: it is computed once, and a
    lost executor costs no more than its own tasks."""
    return persist_table(df, name)


def text_of(column: str) -> Column:
    """The column as text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name where ``df`` already has such a column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], list[Column]]]:
    """``df`` with its columns of these names renamed out of the way of an operator that makes its own, and
    a function that gives the input's columns, under their own names, from what the operator returns."""
    wanted = {n.lower() for n in names}
    taken = {c.lower() for c in df.columns} | wanted
    away = {}
    for column in df.columns:
        if column.lower() in wanted:
            name = f"_{column}"
            while name.lower() in taken:
                name = f"_{name}"
            taken.add(name.lower())
            away[column] = name
    columns = df.columns

    def restored(found: DataFrame) -> list[Column]:
        return [found[away.get(c, c)].alias(c) for c in columns]

    return df.withColumnsRenamed(away), restored
