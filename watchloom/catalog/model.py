"""Typed event classes: how a declared column reads, defaults and prints."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

#: declared type -> Spark type of the normalised column
SPARK_TYPES = {
    "str": "string",
    "int": "int",
    "long": "bigint",
    "float": "double",
    "bool": "boolean",
    "time": "timestamp",
    "map": "map<string,string>",
    "list": "array<string>",
    "mitre": "struct<tactic:string,technique_id:string,technique_name:string>",
    "d3fend": "struct<id:string,description:string>",
    "atlas": "struct<id:string,name:string>",
}


@dataclass(frozen=True)
class ColumnSpec:
    """One column of an event class.

    ``accepts`` lists the input names in order of precedence; the first one that is present in
    a record supplies the value, also when that value is null.
    """

    attr: str
    kind: str
    public: str
    accepts: tuple[str, ...]
    required: bool = False
    nullable: bool = False
    default: str | None = None
    hidden: bool = False
    pinned: bool = False

    @property
    def pinned_by_route(self) -> bool:
        """Columns that a record of no known class takes from its routing keys."""
        return self.attr in ("source", "event_type")

    @property
    def spark_type(self) -> str:
        return SPARK_TYPES[self.kind]


@dataclass(frozen=True)
class EventSpec:
    """One event class: its table, its columns and its feed formats."""

    name: str
    source: str
    type_name: str
    columns: tuple[ColumnSpec, ...]
    feeds: dict = field(default_factory=dict, compare=False)

    @cached_property
    def by_attr(self) -> dict[str, ColumnSpec]:
        return {c.attr: c for c in self.columns}

    @cached_property
    def accepted_names(self) -> frozenset[str]:
        return frozenset(name for c in self.columns for name in c.accepts)


def parse_columns(text: str) -> tuple[ColumnSpec, ...]:
    """Read column declarations: ``attr type names = default``, one per line.

    A type ends in ``!`` when the column is required and in ``?`` when null is a legal value;
    names are separated by ``/`` and the first is the public one; ``hidden`` after the names
    marks an authoring input that is never exported; ``pinned`` one whose value is fixed.
    """
    columns = []
    for line in text.strip().splitlines():
        left, eq, default = line.partition(" = ")
        tokens = left.split()
        attr, kind, flags = tokens[0], tokens[1], tokens[3:]
        names = tuple(dict.fromkeys(tokens[2].split("/")))
        columns.append(
            ColumnSpec(
                attr=attr,
                kind=kind.rstrip("!?"),
                public=names[0],
                # the authoring keys of these two steer routing and are no column names
                accepts=names if attr in ("source", "event_type") else tuple(dict.fromkeys((*names, attr))),
                required=kind.endswith("!"),
                nullable=kind.endswith("?"),
                default=default.strip() if eq else None,
                hidden="hidden" in flags,
                pinned="pinned" in flags,
            )
        )
    return tuple(columns)


def extend(base: tuple[ColumnSpec, ...], own: tuple[ColumnSpec, ...]) -> tuple[ColumnSpec, ...]:
    """Columns of a subclass: a redeclared column keeps its place, new ones follow."""
    override = {c.attr: c for c in own}
    merged = [override.pop(c.attr, c) for c in base]
    return tuple(merged + [c for c in own if c.attr in override])
