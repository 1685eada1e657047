"""Casts that give null for what does not fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_to_int(text: Column) -> Column:
    """Text to integer. Text without a single digit is not even tried, since a failing cast is dear."""
    return F.when(text.rlike("[0-9]"), text.try_cast("int"))


def fitting(column: Column, source: str, target: str) -> Column:
    """``column`` of type ``source`` as ``target``; null where the value does not fit."""
    return text_to_int(column) if (source, target) == ("string", "int") else column.try_cast(target)
