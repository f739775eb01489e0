"""What feature names say: groups by prefix, root groups, and the order that fixes coefficients and ties."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = "0123456789"


def prefix(name: str) -> str:
    """The name without the ASCII digits at its end."""
    return name.rstrip(_DIGITS)


def root_group(name: str) -> str:
    """What stands before the first underscore, or the whole name."""
    return name.partition("_")[0]


def prefix_column(name: Column) -> Column:
    """:func:`prefix` as an expression."""
    return F.regexp_replace(name, "[0-9]+$", "")


def root_group_column(name: Column) -> Column:
    """:func:`root_group` as an expression."""
    return F.substring_index(name, "_", 1)


def groups_by_prefix(names: Iterable[str]) -> dict[str, list[str]]:
    """Names by prefix, prefixes as they first appear; inside, by the number at the end, names without one last."""
    found: dict[str, list[str]] = {}
    for name in names:
        found.setdefault(prefix(name), []).append(name)
    # Sorting is stable, so equal numbers and unnumbered names stay in the order they came in.
    return {p: sorted(members, key=lambda n: (n == p, int(n[len(p) :] or 0))) for p, members in found.items()}


def ordered(groups: Mapping[str, Sequence[str]], columns: Sequence[str]) -> list[str]:
    """The groups' columns that exist, one group after the other, then all other columns."""
    known = set(columns)
    first = [c for members in groups.values() for c in members if c in known]
    taken = set(first)
    return first + [c for c in columns if c not in taken]


def check_names(names: Sequence[str]) -> None:
    """Spark can't tell names apart that differ in case alone; such sets, and repeated names, raise ValueError."""
    seen: dict[str, str] = {}
    for name in names:
        if (other := seen.setdefault(name.lower(), name)) != name or names.count(name) > 1:
            raise ValueError(f"ambiguous feature names: {other!r} and {name!r}")
