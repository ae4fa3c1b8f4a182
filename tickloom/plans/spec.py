"""Feature specs: what to compute, validated and ordered before Spark sees anything."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import Tape


@dataclass(frozen=True)
class Feature:
    """A column: ``name`` is ``operator`` (of ``stage``) over the columns ``deps``."""

    name: str
    stage: str
    operator: str
    deps: tuple[str, ...] = ()
    params: dict = field(default_factory=dict, compare=False)


@dataclass(frozen=True)
class Operator:
    build: Callable[[Tape, list[Column], dict], Column]
    least: int
    most: int
    window: bool


OPERATORS: dict[tuple[str, str], Operator] = {}


def register(stage: str, name: str, deps: int | tuple[int, int], build, window: bool = False) -> None:
    least, most = (deps, deps) if isinstance(deps, int) else deps
    if (stage, name) in OPERATORS:
        raise ValueError(f"{stage} {name} is registered twice")
    OPERATORS[stage, name] = Operator(build, least, most, window)


class SpecError(ValueError):
    pass


def validate(features: list[Feature], columns: list[str]) -> None:
    """Names are unique, operators known, arities kept, windows given, inputs there."""
    names = [f.name for f in features]
    for name in {n for n in names if names.count(n) > 1 or n in columns}:
        raise SpecError(f"{name} is defined twice")
    have = {*columns, *names}
    for f in features:
        op = OPERATORS.get((f.stage, f.operator))
        if op is None:
            raise SpecError(f"{f.name}: no operator {f.operator} in {f.stage}")
        if not op.least <= len(f.deps) <= op.most:
            raise SpecError(f"{f.name}: {f.operator} takes {op.least} to {op.most} inputs, not {len(f.deps)}")
        if op.window and int(f.params.get("window_s", 0)) < 1:
            raise SpecError(f"{f.name}: {f.operator} needs window_s")
        if missing := [d for d in f.deps if d not in have]:
            raise SpecError(f"{f.name}: no column {missing[0]}")
        if "ret_fwd" in " ".join(f.deps) and not f.params.get("target"):
            raise SpecError(f"{f.name}: looks ahead")


def levels(features: list[Feature]) -> list[list[Feature]]:
    """Features by depth: each level needs earlier ones only. A cycle is an error."""
    left, done, out = {f.name: f for f in features}, set(), []
    while left:
        ready = sorted((f for f in left.values() if not any(d in left for d in f.deps)), key=lambda f: f.name)
        if not ready:
            raise SpecError(f"cycle among {sorted(left)}")
        out.append(ready)
        for f in ready:
            del left[f.name]
        done.update(f.name for f in ready)
    return out


def closure(features: list[Feature], wanted: list[str]) -> list[Feature]:
    """The features that ``wanted`` depend on, themselves included."""
    by_name = {f.name: f for f in features}
    need, stack = set(), list(wanted)
    while stack:
        if (name := stack.pop()) in by_name and name not in need:
            need.add(name)
            stack += by_name[name].deps
    return [f for f in features if f.name in need]


@dataclass(frozen=True)
class Chunks:
    """Cut each series into chunks of ``size`` rows. ``part`` rises with the order (an hour, a day) and is what rows are counted by."""

    part: Column
    size: int


def _cut(df: DataFrame, keys: list[str], order: list[str], chunks: Chunks, back: int, ahead: int) -> DataFrame:
    """Rows with ``_place`` in their series and ``_chunk``, repeated for the chunks whose windows reach them.

    Places come from counts per part and the order within a part, so no task
    sorts a whole series. Chunks have equal sizes however the rows lie in time.
    """
    d = df.withColumn("_part", chunks.part)
    counts = d.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_kp"), F.coalesce(before, F.lit(0)).alias("_start"))
    same = F.col("_part").eqNullSafe(F.col("_kp"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    d = d.withColumn("_inside", inside).join(starts, same).withColumn("_place", F.col("_start") + F.col("_inside"))
    first = F.greatest(F.lit(0), F.floor((F.col("_place") - ahead) / chunks.size))
    d = d.withColumn("_chunk", F.explode(F.sequence(first, F.floor((F.col("_place") + back) / chunks.size))))
    return d.select(*df.columns, "_place", "_chunk")


def compute(df: DataFrame, features: list[Feature], keys: list[str], order: list[str], only: list[str] | None = None, chunks: Chunks | None = None) -> DataFrame:
    """``df`` with a column for each feature (of ``only``, if given).

    One exchange by ``keys`` serves all windows: levels are projections and
    windows over the same partitioning and order. With ``chunks``, one long
    series is computed by many tasks: each chunk takes along as many rows
    before and after it as the features' windows reach. Features that depend
    on their whole series (expanding frames, exponential means) are refused then.
    """
    from .. import operators  # noqa: F401  registers

    validate(features, df.columns)
    wanted = only if only is not None else [f.name for f in features]
    by, at = ([*keys, "_chunk"], ["_place"]) if chunks else (keys, order)
    steps, reach, back, ahead = [], {}, 0, 0
    for level in levels(closure(features, wanted)):
        tape = Tape(by, at)
        final = {}
        for f in level:
            params = {**f.params, "names": f.deps}
            final[f.name] = OPERATORS[f.stage, f.operator].build(tape, [F.col(d) for d in f.deps], params)
        # a held column may belong to any feature of its level, so that a level's inputs count for all of it
        inputs = [reach.get(d, (0, 0)) for f in level for d in f.deps]
        for f in level:
            span = tape.span(final[f.name])
            if span is None and chunks:
                raise SpecError(f"{f.name}: {f.operator} runs over its whole series, which has no chunks")
            span = span or (0, 0)
            reach[f.name] = tuple(s + max(i[n] for i in inputs) if inputs else s for n, s in enumerate(span))
            back, ahead = max(back, reach[f.name][0]), max(ahead, reach[f.name][1])
        steps.append((tape, final))
    columns = df.columns
    if chunks:
        df = _cut(df, keys, order, chunks, back, ahead)
    for tape, final in steps:
        for k in sorted(tape.levels):
            df = df.withColumns(tape.levels[k])
        df = df.withColumns({n: c.cast("double") for n, c in final.items()})
        df = df.drop(*(n for k in tape.levels.values() for n in k))
    if chunks:
        df = df.where(F.col("_chunk") == F.floor(F.col("_place") / chunks.size))
    return df.select(*columns, *(f.name for f in features if f.name in wanted))
