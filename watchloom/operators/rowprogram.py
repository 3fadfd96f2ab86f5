"""All event classes in one pass over the routed records.

What differs between classes is data where it can be (the accepted names of each column, by class) and a branch on the
class where it cannot (tests, defaults, feed lines). A record is read once: its accepted names become one array of
given texts, the reasons against it one array, its columns one wide row that has every column of every class once, and
its feed lines one array. Nothing is filtered by class, copied or joined by union.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.catalog.model import ColumnSpec
from watchloom.catalog.tables import GENERIC, spec_of
from watchloom.functions.sqltext import lit, literal_array
from watchloom.operators.normalize import _default, _given, _problem, apply_defaults, cast_columns, lax_cast
from watchloom.operators.pinned import pinned
from watchloom.operators.settings import Settings


def _accepted_names(models: Sequence[str]) -> Column:
    """class -> the accepted input names of each of its columns, in order of precedence."""
    rows = ", ".join(f"{lit(m)}, array({', '.join(literal_array(c.accepts) for c in spec_of(m).columns)})" for m in models)
    return F.expr(f"map({rows})")


def given_texts(routed: DataFrame, models: Sequence[str], raw: str = "raw") -> DataFrame:
    """Routed records of the classes with ``chosen``, the input name that supplies each column of the record's class (null
    when none of its names is present), and ``given``, the value under that name."""
    keys = F.map_keys(raw)
    first = lambda names: F.get(F.filter(names, lambda n: F.array_contains(keys, n)), 0)
    rows = routed.filter(F.col("model").isin(*models))
    rows = pinned(rows, F.transform(F.element_at(_accepted_names(models), F.col("model")), first).alias("chosen"))
    return pinned(rows, F.transform("chosen", lambda n: F.element_at(F.col(raw), n)).alias("given"))


def _errors(models: Sequence[str]) -> str:
    """The reasons against a record of one of the classes, from its ``chosen`` and ``given``, as SQL; null for other classes."""
    branches = []
    for name in models:
        spec = spec_of(name)
        problems = [
            _problem(c, f"(get(chosen, {i}) IS NOT NULL)", f"get(given, {i})", lax_cast(f"get(given, {i})", c))
            for i, c in enumerate(spec.columns) if not (spec is GENERIC and c.pinned_by_route)]
        branches.append(f"WHEN {lit(name)} THEN array_compact(array({', '.join(p for p in problems if p) or 'CAST(NULL AS STRING)'}))")
    return f"CASE model {' '.join(branches)} END"


def judged(routed: DataFrame, models: Sequence[str], raw: str = "raw") -> DataFrame:
    """``given_texts`` with ``errors``, the reasons a record cannot be accepted; empty when it can."""
    return pinned(given_texts(routed, models, raw), F.expr(_errors(models)).alias("errors"))


def judged_whole(routed: DataFrame, models: Sequence[str], raw: str = "raw") -> DataFrame:
    """As ``judged``, with all records: those of other classes have null ``chosen``, ``given`` and ``errors``.

    For few classes and rows that are persisted next. Names are looked up by a branch on the class, in plain projections: these
    are compiled, which ``pinned`` rows are not, and what is persisted is not copied into later steps.
    """
    first = lambda c: "CASE " + " ".join(f"WHEN map_contains_key({raw}, {lit(n)}) THEN {lit(n)}" for n in c.accepts) + " END"
    names = " ".join(f"WHEN {lit(m)} THEN array({', '.join(first(c) for c in spec_of(m).columns)})" for m in models)
    rows = routed.selectExpr("*", f"CASE model {names} END AS chosen")
    width = max(len(spec_of(m).columns) for m in models)
    texts = ", ".join(f"{raw}[get(chosen, {i})]" for i in range(width))
    return rows.selectExpr("*", f"if(chosen IS NULL, NULL, array({texts})) AS given").selectExpr("*", f"{_errors(models)} AS errors")


def table_of(accepted: DataFrame, name: str, settings: Settings = Settings(), keep: Sequence[str] = ("row_id",),
             now: str = "current_timestamp()") -> DataFrame:
    """The typed table of one class from its accepted ``judged`` records."""
    spec = spec_of(name)
    given = accepted.selectExpr("*", *[f"get(given, {i}) AS {_given(c.attr)}" for i, c in enumerate(spec.columns)])
    return cast_columns(apply_defaults(given, spec, settings, now=now), spec, tuple(keep))


def wide_name(c: ColumnSpec) -> str:
    """Where a column of a class stands in the wide row; texts and structures of one name stand apart."""
    return c.attr if c.kind not in ("map", "list") else f"{c.attr}__{c.kind}"


def wide_columns(models: Sequence[str], only: Sequence[str] | None = None) -> dict[str, list[tuple[str, int, ColumnSpec]]]:
    """name in the wide row -> (class, place in the class, column) of every class that has it."""
    out: dict[str, list[tuple[str, int, ColumnSpec]]] = {}
    for m in models:
        for i, c in enumerate(spec_of(m).columns):
            if only is None or c.attr in only:
                out.setdefault(wide_name(c), []).append((m, i, c))
    for name, uses in out.items():
        if len({c.kind for _, _, c in uses}) > 1:
            raise ValueError(f"classes disagree on the type of {name}; export them in runs of their own")
    return out


def wide_rows(accepted: DataFrame, models: Sequence[str], settings: Settings = Settings(), keep: Sequence[str] = ("row_id", "model"),
              only: Sequence[str] | None = None, row_id: str = "row_id", now: str = "current_timestamp()") -> DataFrame:
    """Typed columns of accepted ``judged`` records, defaults filled: each column of each class once, null where the record's
    class does not have it."""
    texts, values = [], []
    columns = wide_columns(models, only)
    for at, uses in columns.items():
        by_text: dict[str, list[str]] = {}
        for name, i, c in uses:
            spec = spec_of(name)
            text = f"get(given, {i})"
            if c.default is not None or spec is GENERIC and c.pinned_by_route:
                text = f"if(get(chosen, {i}) IS NOT NULL, {text}, {_default(c, spec, settings, row_id, now)})"
            by_text.setdefault(text, []).append(name)
        if len(by_text) == 1 and len(uses) == len(models):
            text = next(iter(by_text))
        else:
            text = "CASE " + " ".join(f"WHEN model IN ({', '.join(map(lit, names))}) THEN {t}" for t, names in by_text.items()) + " END"
        texts.append(F.expr(text).alias(f"t_{at}"))
        values.append(F.expr(lax_cast(f"t_{at}", uses[0][2])).alias(at))
    rows = pinned(accepted.select(*dict.fromkeys([*keep, "model", "chosen", "given", "route_source", "route_type", row_id])), *texts)
    return pinned(rows.select(*keep, *[f"t_{at}" for at in columns]), *values).select(*keep, *columns)


def accepted_rows(routed: DataFrame, models: Sequence[str], settings: Settings = Settings(), keep: Sequence[str] = ("row_id", "model"),
                  only: Sequence[str] | None = None, now: str = "current_timestamp()") -> DataFrame:
    """The wide rows of all records that their class accepts, in one pass."""
    return wide_rows(judged(routed, models).filter(F.size("errors") == 0), models, settings, keep, only, now=now)
