"""Detection rules over tables."""

from __future__ import annotations

import re
import re._constants as regex_ops
import re._parser as regex_parser
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from watchloom.catalog import dims
from watchloom.session import stored


@dataclass(frozen=True)
class Rule:
    rule_id: str
    level: int
    column: str
    pattern: str
    description: str


DEFAULT_RULES = tuple(Rule(*r) for r in dims.RULES)


def _hits(df: DataFrame, rules: Sequence[Rule]) -> Column:
    usable = [r for r in rules if r.column in df.columns]
    tests = [
        F.when(F.col(r.column).rlike(r.pattern), F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.level).alias("level"),
            F.lit(r.column).alias("column"), F.lit(r.description).alias("description")))
        for r in usable
    ]
    if not tests:
        return F.expr("CAST(array() AS array<struct<rule_id:string,level:int,column:string,description:string>>)")
    return F.filter(F.array(*tests), lambda h: h.isNotNull())


def detect(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, keep: Sequence[str] = ("Id",)) -> DataFrame:
    """One row per (event, rule that fires). All rules are tested in one pass; only the columns a
    rule names are read, and no row is repeated per rule. A rule whose column is not there cannot fire; ``unused_rules``
    reports it."""
    return df.select(*keep, F.inline(_hits(df, rules)))


def read_rules(rules: DataFrame) -> tuple[Rule, ...]:
    """Rules kept in a table (a configuration, one row per rule)."""
    rows = rules.select("rule_id", "level", "column", "pattern", "description").collect()
    return tuple(Rule(*row) for row in sorted(rows, key=lambda r: r["rule_id"]))


def detect_long(values: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """The same over rows ``column, value``: each value meets only the rules of its column, in one
    pass and without a join."""
    tests = [
        F.when((F.col("column") == r.column) & F.col("value").rlike(r.pattern), F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.level).alias("level"),
            F.lit(r.description).alias("description")))
        for r in rules
    ]
    hits = F.filter(F.array(*tests), lambda h: h.isNotNull())
    return values.select(*keep, "column", F.inline(hits))


# --- rule tables of any size --------------------------------------------------------------

#: characters of a piece of text that rules and values are joined on: a rule has one of the greatest size that its text allows
GRAMS = (4, 8, 16)
#: flags behind an anchor: Java takes them anywhere, Python at the start only; none of them changes which text must be there
_FLAGS = re.compile(r"^\^+[(][?][ims]+[)]")


def required_text(pattern: str) -> str:
    """The longest text in lower case that every match of a pattern holds, as far as its structure shows it; '' when it
    shows none. Only plain ASCII counts, and a pattern that Python's parser does not take shows nothing."""
    runs, now = [], []

    def close() -> None:
        runs.append("".join(now))
        now.clear()

    def walk(parts) -> None:
        for op, arg in parts:
            if op is regex_ops.LITERAL and 32 <= arg < 127:
                now.append(chr(arg).lower())
            elif op is regex_ops.SUBPATTERN:
                walk(arg[3])
            elif op in (regex_ops.MAX_REPEAT, regex_ops.MIN_REPEAT, regex_ops.POSSESSIVE_REPEAT) and arg[0] > 0:
                close()
                walk(arg[2])
                close()
            elif op is not regex_ops.AT:
                close()

    try:
        walk(regex_parser.parse(_FLAGS.sub("", pattern)))
    except (re.error, OverflowError, RecursionError):
        return ""
    close()
    return max(runs, key=len)


@F.pandas_udf(StringType())
def _required(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda pattern: required_text(pattern or ""))


def _pieces(text: Column, size: int) -> Column:
    """The distinct pieces of a text that have a size; a text must be at least that long."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: F.substr(text, i, F.lit(size))))


def rule_index(rules: DataFrame) -> DataFrame:
    """Rules ``rule_id, level, column, pattern, description`` with ``gram``, a piece of text that every match holds (null: none is known).

    Of the pieces of the greatest size that its text allows a rule takes the one that fewest rules of its column hold.
    """
    shown = ["rule_id", "level", "column", "pattern", "description"]
    numbered = stored(rules.select(*shown, F.uuid().alias("_rule"), _required("pattern").alias("_text")))
    text = F.col("_text")
    pieces = F.when(F.length(text) >= GRAMS[-1], _pieces(text, GRAMS[-1]))
    for size in reversed(GRAMS[:-1]):
        pieces = pieces.when(F.length(text) >= size, _pieces(text, size))
    held = numbered.select("_rule", "column", F.explode(pieces).alias("gram"))
    often = held.groupBy("column", "gram").agg(F.count("*").alias("n"))
    rarest = held.join(often, ["column", "gram"]).groupBy("_rule").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    return numbered.join(rarest, "_rule", "left").select(*shown, "gram")


def detect_indexed(values: DataFrame, rules: DataFrame, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """One row per (value, rule that fires) over rows ``column, value``, for a table of rules of any size.

    A value meets the rules whose required piece of text it holds, by an equality join of pieces, and is then tested
    against those alone. Rules without such a piece are tested against every value of their column. Rules are never
    collected; a value counts once for a rule.
    """
    index = stored(rule_index(rules))  # both joins read it
    low = F.lower("value")
    shown = [*keep, "column", "value"]
    # only sizes that rules of the column have: at most one short row a size and column
    sizes = index.filter(F.col("gram").isNotNull()).groupBy("column").agg(F.collect_set(F.length("gram")).alias("_sizes"))
    pieces = F.flatten(F.array(*[
        F.when(F.array_contains("_sizes", n) & (F.length(low) >= n), _pieces(low, n)).otherwise(F.expr("CAST(array() AS array<string>)")) for n in GRAMS]))
    parts = values.join(sizes, "column").select(*shown, F.explode(pieces).alias("gram"))
    likely = parts.join(index.filter(F.col("gram").isNotNull()), ["column", "gram"]).drop("gram")
    other = values.select(*shown).join(index.filter(F.col("gram").isNull()).drop("gram"), "column")
    met = likely.unionByName(other).filter(F.rlike(F.col("value"), F.col("pattern")))
    return met.select(*keep, "column", "rule_id", "level", "description")


def unused_rules(rules: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rules that can never fire because no such column is there."""
    return rules.filter(~F.col("column").isin(*columns)).select("rule_id", "column")


def rule_hits(hits: DataFrame) -> DataFrame:
    return hits.groupBy("rule_id", "level").agg(F.count("*").alias("hits"))


def rule_quality(df: DataFrame, rules: Sequence[Rule], label: str) -> DataFrame:
    """Precision and recall of each rule against the labels: one pass, one row per rule. A rule whose column is not there
    has null counts."""
    aggs = []
    for i, r in enumerate(rules):
        if r.column not in df.columns:
            aggs += [F.lit(None).cast("bigint").alias(f"h{i}"), F.lit(None).cast("bigint").alias(f"t{i}")]
            continue
        fired = F.coalesce(F.col(r.column).rlike(r.pattern), F.lit(False))
        aggs += [F.count_if(fired).alias(f"h{i}"), F.count_if(fired & F.col(label)).alias(f"t{i}")]
    totals = df.agg(F.count_if(F.col(label)).alias("positives"), *aggs)
    rows = F.array(*[
        F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"h{i}").alias("hits"), F.col(f"t{i}").alias("true_hits"))
        for i, r in enumerate(rules)])
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6)
    return totals.select("positives", F.inline(rows)).select(
        "rule_id", "hits", "true_hits", share("true_hits", "hits").alias("precision"),
        share("true_hits", "positives").alias("recall"))
