"""Input columns under names of their own, so that extra columns can't clash with what an operator makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apart(docs: DataFrame, made: list[str], needed: list[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its columns as ``__c0``, ``__c1``, ... beside copies of the ``needed`` ones, and the columns that give
    them back. Columns that the operator makes itself (``made``) replace input columns of the same name."""
    inner = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)]
    taken = {m.lower() for m in made}
    back = [F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in taken]
    return docs.select(*inner, *[F.col(c).alias(c) for c in needed]), back
