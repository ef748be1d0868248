"""One plan over several cycles whose files name and code things differently."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.design import SurveyDesign
from . import stats

#: What the codes of a column mean: column -> code -> meaning.
Meanings = Mapping[str, Mapping[object, str]]


@dataclass(frozen=True)
class Plan:
    """A mean (no ``group``) or a gap (codes ``a`` minus ``b`` of ``group``) of a measure, by group columns.

    ``measure`` has an expression for each imputation, ``where`` is a condition; both are SQL over a cycle's file.
    """

    measure: tuple[str, ...]
    by: tuple[str, ...] = ()
    where: str | None = None
    group: str | None = None
    a: object = None
    b: object = None


@dataclass(frozen=True)
class CyclePlan:
    """A plan as it holds in one cycle: its own columns, and how its group columns become the main plan's."""

    plan: Plan
    rename: tuple[tuple[str, str], ...] = ()
    recode: Mapping[str, Mapping[object, object]] = field(default_factory=dict)
    notes: tuple[str, ...] = ()


def _codes(name: str, main: str, meanings: Meanings) -> dict[object, object]:
    """Codes of a column as those of the main plan's column that mean the same; empty where either's meanings are unknown."""
    if name == main or name not in meanings or main not in meanings:
        return {}
    back = {meaning: code for code, meaning in meanings[main].items()}
    return {code: back[meaning] for code, meaning in meanings[name].items() if meaning in back}


def resolve(plan: Plan, override: Mapping[str, object], columns: Sequence[str], meanings: Meanings) -> CyclePlan | str:
    """The plan in a cycle with these columns, or why the cycle has none.

    ``override`` replaces fields of the plan. Group columns under other names are renamed to the main plan's,
    and recoded to its codes by what codes mean. A contrast on another column keeps the main plan's direction
    whatever codes the override gives, so that a change between cycles holds no change of sign.
    """
    own, notes = replace(plan, **override), []
    if len(own.by) != len(plan.by):
        return f"its group columns {', '.join(own.by)} are not as many as the plan's"
    have = {c.lower() for c in columns}
    wanted = [*own.by, *([own.group] if own.group else [])]
    if gone := [c for c in wanted if c.lower() not in have]:
        return f"it has no {', '.join(gone)}"
    if own.group and own.group != plan.group and plan.group in meanings:
        inverse = {meaning: code for code, meaning in meanings.get(own.group, {}).items()}
        sides = [inverse.get(meanings[plan.group].get(c)) for c in (plan.a, plan.b)]
        if None in sides:
            return f"codes of {own.group} do not tell {plan.group}'s sides apart"
        if [own.a, own.b] != sides:
            notes.append(f"{own.group}: {own.a} minus {own.b} was turned into {sides[0]} minus {sides[1]}, as {plan.group} has it")
        own = replace(own, a=sides[0], b=sides[1])
    rename = tuple((x, y) for x, y in zip(own.by, plan.by, strict=True) if x != y)
    recode = {y: codes for x, y in rename if (codes := _codes(x, y, meanings))}
    return CyclePlan(own, rename, recode, tuple(notes))


def _estimates(df: DataFrame, design: SurveyDesign, found: CyclePlan, label: str | None) -> DataFrame:
    plan = found.plan
    measure, where = [F.expr(m) for m in plan.measure], F.expr(plan.where) if plan.where else None
    by = list(plan.by)
    for own, main in found.rename:
        value: Column = F.col(own)
        if codes := found.recode.get(main):
            # a code without a meaning in the main plan stays apart as NULL
            value = reduce(lambda w, kv, own=own: w.when(F.col(own) == kv[0], kv[1]), list(codes.items())[1:], F.when(F.col(own) == list(codes)[0], list(codes.values())[0]))
        df = df.withColumn(f"_by_{main}", value)
        by[by.index(own)] = f"_by_{main}"
    if plan.group:
        out = stats.gap(df, design, measure, F.col(plan.group), plan.a, plan.b, by, where, label)
    else:
        out = stats.weighted_mean(df, design, measure, by, where)
    return out.withColumnsRenamed({f"_by_{main}": main for _, main in found.rename})


def over_cycles(
    cycles: Mapping[str, DataFrame], design: SurveyDesign, plan: Plan, overrides: Mapping[str, Mapping[str, object]] = {}, meanings: Meanings = {}
) -> tuple[DataFrame, dict[str, tuple[str, ...]]]:
    """Estimates of every cycle under one another (column ``cycle``), and what was done to or said about each cycle.

    A cycle that the plan cannot be resolved in is left out with its reason; none left raises.
    """
    notes: dict[str, tuple[str, ...]] = {}
    parts = []
    for cycle, df in cycles.items():
        found = resolve(plan, overrides.get(cycle, {}), df.columns, meanings)
        if isinstance(found, str):
            notes[cycle] = (f"left out: {found}",)
            continue
        notes[cycle] = found.notes
        label = f"{plan.a} minus {plan.b}" if plan.group else None
        parts.append(_estimates(df, design, found, label).select(F.lit(cycle).alias("cycle"), "*"))
    if not parts:
        raise ValueError("; ".join(f"{c}: {n[0]}" for c, n in notes.items()))
    return reduce(DataFrame.unionByName, parts), notes
