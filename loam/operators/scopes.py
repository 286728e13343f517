"""Keys that carry the bundle they belong to, so that a join, a group or a component never meets another bundle's."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Stands between a bundle's name and a key in it; no name may hold it.
SEPARATOR = "\x1f"


def scoped(bundle: Column, key: Column) -> Column:
    """The key with its bundle before it; null where either is."""
    return F.concat(bundle, F.lit(SEPARATOR), key)


def bundle_of(key: Column) -> Column:
    return F.substring_index(key, SEPARATOR, 1)


def within(key: Column) -> Column:
    """A scoped key as its bundle knows it."""
    return F.substr(key, F.length(bundle_of(key)) + F.lit(2))
