"""Leakage governance: checks on column names and verdicts that cost nothing to run."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F


class LeakageError(ValueError):
    """A column that must not reach a model."""


@dataclass(frozen=True)
class FeatureSet:
    """A named, ordered list of features; leaks names those that it is allowed to hold nevertheless."""

    name: str
    features: tuple[str, ...]
    valid: bool = True
    leaks: frozenset[str] = field(default=frozenset())

    def __post_init__(self):
        if self.valid and self.leaks:
            raise LeakageError(f"{self.name} is valid and yet declares leaks")


class UnknownName(KeyError):
    """A name that a registry does not hold; the message lists those that it does."""


class ParseError(ValueError):
    """A label that is no interval where one is needed."""


@dataclass(frozen=True)
class Variable:
    """A variable of the registry: its category of leakage, its tier of cost, and whether its meaning is in doubt."""

    name: str
    category: str
    tier: str = "standard"
    uncertain: bool = False


@dataclass(frozen=True)
class Registry:
    """Feature sets and variables by name."""

    sets: tuple[FeatureSet, ...] = ()
    variables: tuple[Variable, ...] = ()

    def by_name(self, name: str) -> FeatureSet:
        for s in self.sets:
            if s.name == name:
                return s
        raise UnknownName(f"{name!r} is unknown; known: {', '.join(sorted(s.name for s in self.sets))}")

    def valid_names(self) -> list[str]:
        return [s.name for s in self.sets if s.valid]

    def uncertain(self) -> list[Variable]:
        return [v for v in self.variables if v.uncertain]

    def by_tier(self, tier: str) -> list[Variable]:
        found = [v for v in self.variables if v.tier == tier]
        if not found:
            raise UnknownName(f"tier {tier!r} is unknown; known: {', '.join(sorted({v.tier for v in self.variables}))}")
        return found


#: The categories of leakage that restrict a feature set.
CRITERION, SEDIMENT, CONSEQUENCE, DERIVED, EARLY = "diagnostic_criterion_input", "possible_criterion_sediment", "consequence_of_advanced_disease", "deterministic_outcome_derivative", "legitimate_pre_index"

#: Name, whether the set starts from the low-cost features, the categories that it drops, the one limb of the
#: outcome's definition that it drops, the category that it is confined to, and whether doubtful variables go.
RESTRICTIONS = [
    ("full_valid (reference)", False, [], None, None, False),
    ("minus creatinine/eGFR information", False, [DERIVED], "creatinine", None, False),
    ("minus albuminuria information", False, [], "albuminuria", None, False),
    ("minus criterion inputs only (strict)", False, [CRITERION], None, None, False),
    ("minus all incorporation-risk variables", False, [CRITERION, SEDIMENT], None, None, False),
    ("minus consequences of advanced disease", False, [CONSEQUENCE], None, None, False),
    ("minus incorporation and consequences", False, [CRITERION, SEDIMENT, CONSEQUENCE], None, None, False),
    ("pre-index available only", False, [], None, EARLY, False),
    ("conservative pre-index (no uncertain)", False, [], None, EARLY, True),
    ("minimal low-cost conservative", True, [], None, EARLY, True),
]
RESTRICTION = "name string, low_cost boolean, dropped array<string>, limb string, within string, certain boolean"


def restricted_sets(registry: DataFrame, restrictions: list[tuple] = RESTRICTIONS) -> DataFrame:
    """(name, n, features) of each restriction: the variables of a registry that it leaves, in the registry's order.

    registry has place, variable, category, limb, uncertain and low_cost, a row
    per variable. A restriction without any variable left has n 0; null
    category and limb are none, null uncertain and low_cost are false.
    """
    rules = registry.sparkSession.createDataFrame(restrictions, RESTRICTION)
    no = F.lit(False)
    stays = ~F.coalesce(F.array_contains("dropped", F.col("category")), no) & ~F.coalesce(F.col("limb") == F.col("_limb"), no)
    stays = stays & (F.col("within").isNull() | F.coalesce(F.col("within") == F.col("category"), no)) & ~(F.col("certain") & F.coalesce("uncertain", no))
    variables = registry.select("place", "variable", "category", F.col("limb").alias("_limb"), "uncertain", F.col("low_cost").alias("_low"))
    rows = rules.join(variables, ~F.col("low_cost") | F.coalesce("_low", no), "left")  # rules are the ten rows above
    kept = F.array_sort(F.collect_list(F.when(stays & F.col("variable").isNotNull(), F.struct("place", "variable"))))
    return rows.groupBy("name").agg(kept.alias("kept")).select("name", F.size("kept").cast("long").alias("n"), F.array_join(F.col("kept.variable"), ",").alias("features"))


def gated(df: DataFrame, verdict: str, wanted: str | None = None) -> DataFrame:
    """df, if the verdict is the wanted one (by default any but OVERLAPPING)."""
    if wanted is None and verdict == "OVERLAPPING":
        raise LeakageError("the verdict is OVERLAPPING")
    if wanted is not None:
        gate(verdict, wanted)
    return df


def base_name(column: str) -> str:
    """The variable that an encoded column comes from."""
    return column.split("__")[0]


def guard(df: DataFrame, forbidden: Iterable[str], allow: Iterable[str] = ()) -> DataFrame:
    """df, if none of its columns comes from a forbidden variable."""
    barred = set(forbidden) - set(allow)
    found = [c for c in df.columns if base_name(c) in barred]
    if found:
        raise LeakageError(f"forbidden columns: {', '.join(sorted(found))}")
    return df


def select_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The columns in order; an absent one is an error."""
    columns = list(columns)
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise LeakageError(f"absent columns: {', '.join(absent)}")
    return df.select(*columns)


def assert_clean(df: DataFrame, features: FeatureSet, forbidden: Iterable[str], outcome: str) -> DataFrame:
    """df restricted to a feature set whose variables are all declared, without the outcome or undeclared leaks."""
    declared = set(features.features)
    for c in df.columns:
        if base_name(c) == outcome:
            raise LeakageError("the outcome is among the features")
        if base_name(c) not in declared:
            raise LeakageError(f"{c} is not declared")
    return guard(df, forbidden, features.leaks)


def gate(verdict: str, wanted: str) -> None:
    """Go on only with the wanted verdict."""
    if verdict != wanted:
        raise LeakageError(f"the verdict is {verdict}, not {wanted}")
