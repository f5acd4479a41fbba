"""What a query over linked tables is made of: tables with roles, join edges, a plan, filters."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from tessella.functions.predicates import Filters, values_of


class Role(Enum):
    MASTER = "master"
    ASSOCIATION = "association"
    SATELLITE = "satellite"
    DECORATION = "decoration"


@dataclass(frozen=True)
class TableSpec:
    name: str
    role: Role
    key: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    derived: tuple[str, ...] = ()


@dataclass(frozen=True)
class JoinEdge:
    left: str
    right: str
    left_on: tuple[str, ...]
    right_on: tuple[str, ...]

    def turned(self) -> JoinEdge:
        return JoinEdge(self.right, self.left, self.right_on, self.left_on)


@dataclass(frozen=True)
class SortKey:
    """Orders a result by a column, where it has it: by the place in a list of categories (others last), by whether it
    contains one of some terms, whatever their case, or by its value."""

    column: str
    descending: bool = False
    order: tuple[str, ...] = ()
    contains_first: tuple[str, ...] = ()


@dataclass(frozen=True)
class StarPlan:
    """Tables in the order of parents; each but the first names the table it hangs on."""

    parents: dict[str, str | None]
    joins: tuple[JoinEdge, ...] = ()
    outputs: tuple[str, ...] = ()
    decorations: frozenset[str] = frozenset()
    require_all: dict[str, list[str]] = field(default_factory=dict)
    rank: tuple[tuple[str, bool], ...] = ()  # (column, descending), the first present one ranks
    tie_breakers: tuple[str, ...] = ()
    strict: bool = True
    sort: tuple[SortKey, ...] = ()  # before the rank; rows that these don't tell apart stay in its order
    rewrites: dict[str, dict[str, str]] = field(default_factory=dict)  # column -> value in lower case -> what the table has

    def edge(self, a: str, b: str) -> JoinEdge | None:
        for e in self.joins:
            if (e.left, e.right) == (a, b):
                return e
            if (e.right, e.left) == (a, b):
                return e.turned()
        return None


class NoFilterError(ValueError):
    """No usable filter is left."""


class MissingJoinError(ValueError):
    """Two tables of a plan have no join columns."""


class ExplosionError(ValueError):
    """A join would make far more rows than it reads."""


def normalise_filters(raw: dict) -> Filters:
    """Bare values become lists; blanks go; "requested" stays a request."""
    out: Filters = {}
    for k, v in raw.items():
        if v == "requested":
            out[k] = v
            continue
        values = [x for x in (v if isinstance(v, (list, tuple)) else [v]) if x is not None and str(x).strip() and x != "requested"]
        if values:
            out[k] = list(values)
        elif isinstance(v, (list, tuple)) and "requested" in v:
            out[k] = "requested"
    return out


def guard_filters(filters: Filters, known: set[str]) -> None:
    if not any(values_of(filters, k) for k in filters):
        raise NoFilterError("no filter has a value")
    if not known & set(filters):
        raise NoFilterError(f"no table has any of {sorted(filters)}")


def literal_floor(resolved: Filters, literal: Filters) -> Filters:
    """Fields that resolution left empty fall back to their literal terms; requests stay."""
    out = dict(resolved)
    for k, v in literal.items():
        if v == "requested":
            out.setdefault(k, v)
        elif not values_of(out, k):
            out[k] = [str(x).strip() for x in values_of(literal, k)]
    return {k: v for k, v in out.items() if v}
