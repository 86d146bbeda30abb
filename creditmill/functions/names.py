"""Column-name rules: quoting, aggregate names, sanitizing."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: characters a model library accepts in a feature name
_UNSAFE = re.compile(r"[^A-Za-z0-9_]+")


def quoted(name: str) -> str:
    """A column name as SQL; names may hold spaces, dots, slashes or commas."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """A string literal as SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def col(name: str) -> Column:
    return F.col(quoted(name))


def aggregate_name(prefix: str, column: str, stat: str) -> str:
    return f"{prefix}_{column}_{stat.upper()}"


def safe_name(name: str) -> str:
    return _UNSAFE.sub("_", name)


def safe_names(names: Iterable[str]) -> list[str]:
    """Sanitize all names; two names that fall together are an error, not a silent overwrite."""
    names = list(names)
    seen: dict[str, str] = {}
    for name in names:
        clean = safe_name(name).lower()
        if clean in seen:
            raise ValueError(f"{seen[clean]!r} and {name!r} have the same sanitized name")
        seen[clean] = name
    return [safe_name(name) for name in names]


def first_occurrences(names: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(names))
