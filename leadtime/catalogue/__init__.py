"""Queries over the given tables, each with the SQL that must give the same rows where there is one."""

from leadtime.catalogue import cleaning, evaluation, features, flows, joins, learning, profiles, storage  # noqa: F401
from leadtime.catalogue.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
