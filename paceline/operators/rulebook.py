"""The rule book of features, carried by the columns themselves.

A feature column says in its Spark metadata at which stage of a weekend it is known and, of recency features, which
half-life it has. Spark keeps metadata through selects, filters, joins and new names, so a column can't pass as another by
being renamed. It doesn't keep it for columns computed from others, and a column without a stage is refused; derive()
computes one and gives it the latest stage of its inputs. What a target may know is checked on the frame that is handed
over, not on names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.operators import circuits, form
from paceline.operators.form import OPTIONAL, RACE, STAGES

#: Stages in the order in which they become known. Keys tell rows apart and are no features.
ORDER = ("key", "pre_weekend", "recency", "post_practice", "post_quali", "scenario")
#: Stages that targets may know: gaps and slots of qualifying are known no later than its places. Fixed rules.
TARGETS = STAGES | {"qgap": STAGES["quali"], "grid": STAGES["quali"]}
KEYS = (*RACE, "driver", "team")
BUILDERS = form.BUILDERS | {"pre_weekend": (form.driver_form, form.team_form, circuits.circuit_history, form.context)}


class StageError(ValueError):
    """A frame holds what its target may not know, or what no stage is known of."""


def marked(column: Column, name: str, stage: str, half_life: int | None = None) -> Column:
    return column.alias(name, metadata={"stage": stage} | ({} if half_life is None else {"half_life": half_life}))


def mark(df: DataFrame, stage: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """df with the stage on every column that isn't a key. Half-lives follow from names that end in _ew and a number."""
    def one(name: str) -> Column:
        if name in keys:
            return marked(F.col(name), name, "key")
        end = name.rsplit("_ew", 1)[-1] if "_ew" in name else ""
        return marked(F.col(name), name, stage, int(end) if end.isdigit() else None)

    return df.select(*map(one, df.columns))


def stage_of(field: T.StructField) -> str | None:
    return (field.metadata or {}).get("stage")


def derive(df: DataFrame, name: str, expression: Column, *inputs: str) -> DataFrame:
    """df with a column computed from the inputs, known when the last of them is."""
    found = {c: stage_of(df.schema[c]) for c in inputs}
    if missing := [c for c, s in found.items() if s is None] or (not inputs and ["no inputs"]):
        raise StageError(f"{name} comes from columns without a stage: {missing}")
    # what an expression reads shows when it is analysed on the inputs alone
    df.select(*inputs).select(expression)
    return df.withColumn(name, marked(expression, name, max(found.values(), key=ORDER.index)))


def allowed(target: str, optional: tuple[str, ...] = ()) -> tuple[str, ...]:
    """The stages of the target's features; optional ones must be asked for, and may not be for every target."""
    if target not in TARGETS:
        raise ValueError(f"no target {target}; there are {sorted(TARGETS)}")
    if refused := [s for s in optional if s not in TARGETS[target]]:
        raise StageError(f"{target} can't use {refused}")
    return tuple(s for s in TARGETS[target] if s not in OPTIONAL or s in optional)


def checked(df: DataFrame, target: str, optional: tuple[str, ...] = ()) -> DataFrame:
    """df, refused if one of its columns isn't known at a stage that the target may use. Looks at the analysed schema only."""
    may = (*allowed(target, optional), "key")
    if unknown := [f.name for f in df.schema if stage_of(f) is None]:
        raise StageError(f"no stage is known of {unknown}")
    if refused := {f.name: stage_of(f) for f in df.schema if stage_of(f) not in may}:
        raise StageError(f"{target} can't use {refused}")
    return df


def feature_columns(df: DataFrame, target: str, optional: tuple[str, ...] = (), half_life: int | None = None, with_grid: bool = True) -> list[str]:
    """The features of a marked frame that a model of the target gets, in order.

    half_life: of features with one, only those. Without the grid, what is known only after qualifying is left out too.
    """
    may = [s for s in allowed(target, optional) if with_grid or s != "post_quali"]
    fits = lambda f: half_life is None or "half_life" not in f.metadata or f.metadata["half_life"] == half_life
    out = [f.name for f in df.schema if stage_of(f) in may and fits(f)]
    if half_life is not None and "recency" in optional and not any((f.metadata or {}).get("half_life") == half_life for f in df.schema):
        raise ValueError(f"no feature has a half-life of {half_life}")
    return out


def all_features(history: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """Keys and every feature of these stages, marked. For those who then take from it what a target may know."""
    out = mark(history.select(*KEYS), "key")
    for stage in (s for s in ORDER if s in stages and s in BUILDERS):
        for build in BUILDERS[stage]:
            part = mark(build(history), stage)
            out = out.join(part, [c for c in KEYS if c in part.columns], "left")
    return out


def feature_table(history: DataFrame, target: str = "finish", optional: tuple[str, ...] = (), half_life: int | None = None, with_grid: bool = True) -> DataFrame:
    """Keys and features of the target, all with their stages."""
    stages = tuple(s for s in allowed(target, optional) if with_grid or s != "post_quali")
    out = all_features(history, stages)
    return checked(out.select(*KEYS, *feature_columns(out, target, optional, half_life, with_grid)), target, optional)


def outcome(target: str) -> Column:
    return {"finish": F.col("position"), "quali": F.col("quali"), "qgap": F.col("quali_gap"), "grid": F.when(F.col("grid") > 0, F.col("grid")), "dnf": F.col("dnf").cast("double")}[target]


def training_frame(history: DataFrame, target: str = "finish", optional: tuple[str, ...] = (), half_life: int | None = None, with_grid: bool = True) -> DataFrame:
    """Counting rows with a known outcome y, and the target's features."""
    known = history.filter("race_ok").select(*RACE, "driver", outcome(target).alias("y")).filter(F.col("y").isNotNull())
    return feature_table(history, target, optional, half_life, with_grid).join(known, [*RACE, "driver"])
