"""Decision logic as columns: guarded definitions, exceptions that override, tables looked up, reasons gathered.

A rule set is evaluated for all rows in one select; which rules exist is plan-time data. Where exactly one value
must come out, resolve gives it, or raises or reports when none or several different ones do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a lookup table up to which it is sent to every task.
TABLE_ROWS = 200_000


@dataclass
class Rule:
    """value holds where condition does; of its exceptions, one that fires comes before it."""

    name: str
    condition: Column
    value: Column
    exceptions: list[Rule] = field(default_factory=list)


def _bound(value: Column, say: Callable[[Column], Column]) -> Column:
    """say of value, which stands in the plan once, however often say mentions it."""
    return F.get(F.transform(F.array(value), say), F.lit(0))


def _fired(rules: list[Rule]) -> Column:
    """The distinct values that rules of one rank give, null for none; two or more are a conflict, as is one below.

    Each rule stands in the plan once, whatever the depth of its exceptions.
    """
    given = []
    for r in rules:
        own = F.when(r.condition, F.array(r.value))
        given.append(F.coalesce(_fired(r.exceptions), own) if r.exceptions else own)
    values = F.array_distinct(F.filter(F.flatten(F.array_compact(F.array(*given))), lambda v: v.isNotNull()))
    return F.get(F.filter(F.array(values), lambda a: F.size(a) > 0), F.lit(0))


def resolve(rules: list[Rule], strict: bool = True) -> Column:
    """The one value that the rules give. Without any, or with several, strict raises; else the result is null."""
    names = ", ".join(r.name for r in rules)
    if not strict:
        return _bound(_fired(rules), lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))))
    said = lambda text: F.raise_error(F.lit(f"{text}: {names}"))
    return _bound(_fired(rules), lambda a: F.when(a.isNull(), said("no value")).when(F.size(a) > 1, said("conflicting values")).otherwise(F.get(a, F.lit(0))))


def status(rules: list[Rule]) -> Column:
    """value, none or conflict."""
    return _bound(_fired(rules), lambda a: F.when(a.isNull(), "none").when(F.size(a) > 1, "conflict").otherwise("value"))


def fulfilled(*conditions: Column) -> Column:
    """Whether any condition holds; unknown ones do not."""
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def given(value: Column, default: Column) -> Column:
    """What the caller gives, else the default."""
    return F.coalesce(value, default)


def reasons(codes: dict[str, Column]) -> Column:
    """The codes of the conditions that hold, in the order in which they are declared."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), code) for code, c in codes.items()]))


def violations(assertions: dict[str, Column]) -> Column:
    """The messages of the assertions that do not hold; unknown counts as not holding."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), m) for m, c in assertions.items()]))


def first_of(outcomes: list[tuple[Column, str]], otherwise: str) -> Column:
    """The outcome of the first condition that holds."""
    out = None
    for c, o in outcomes:
        out = F.when(c, o) if out is None else out.when(c, o)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def tier(value: Column, steps: list[tuple[float, str]], below: str) -> Column:
    """The highest step that value reaches."""
    return first_of([(value >= s, name) for s, name in sorted(steps, reverse=True)], below)


def look_up(cases: DataFrame, table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """cases with value from the table and found; a miss is null and False. The table's keys must be unique.

    A table of few rows is sent to every task, a larger one is joined by shuffle.
    """
    small = table.limit(TABLE_ROWS + 1).count() <= TABLE_ROWS
    right = table.select(*keys, value).withColumn("found", F.lit(True))
    return cases.join(F.broadcast(right) if small else right, keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def canonical_json(values: Column) -> Column:
    """A MAP<STRING, STRING> as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def evaluate(cases: DataFrame, outputs: dict[str, Column], codes: dict[str, Column]) -> DataFrame:
    """cases with outputs STRUCT, reasons and decided, which is false where any output is null."""
    out = F.struct(*[c.alias(n) for n, c in outputs.items()])
    decided = F.lit(True)
    for c in outputs.values():
        decided = decided & c.isNotNull()
    return cases.withColumns({"outputs": out, "reasons": reasons(codes), "decided": decided})


def condition(tree: Column | list | dict) -> Column:
    """A nested condition as one column: a list or all_of holds if all of it does, any_of if any; nothing holds for none."""
    if isinstance(tree, Column):
        return tree
    if isinstance(tree, list):
        tree = {"all_of": tree}
    (how, parts), = tree.items()
    if how not in ("all_of", "any_of"):
        raise ValueError(f"unknown condition {how}")
    out = F.lit(how == "all_of")
    for part in map(condition, parts):
        out = out & part if how == "all_of" else out | part
    return out


def trace(rules: dict[str, Column]) -> Column:
    """ARRAY<STRUCT<step, code, held>>: what each rule came to, in the order of the rules; an unknown one did not hold."""
    return F.array(*[F.struct(F.lit(i).alias("step"), F.lit(code).alias("code"), F.coalesce(c, F.lit(False)).alias("held")) for i, (code, c) in enumerate(rules.items(), 1)])
