"""Allow-listed hosts: deny by default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    """The lower-case host without user, port, path, query or fragment."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def body(html: Column, most: int = 100_000) -> Column:
    """The first ``most`` bytes of a page, as text."""
    return F.decode(F.substring(html.cast("binary"), 1, most), "UTF-8")
