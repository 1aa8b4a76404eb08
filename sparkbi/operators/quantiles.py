"""Exact quantiles per group from mergeable sketches, without sorting or shuffling the values.

A first scan makes a KLL sketch of every group. Of a group that fits the sketch it holds every value, so
its quantiles are exact at once. For a larger group it gives two cut values close to each wanted
position. The next scan counts the values below, at and above the cuts and sketches only those between them, a small
share of the group, and so on until what is left fits. Only sketches and counts are ever shuffled, a
row per task and group, whatever the number of values, and a value with very many copies is a count like
any other. A sketch that is off by more than expected makes a cut miss its position; the counts show
it, and the search goes on in the part where the position is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sparkbi.session import cut_lineage

#: Sketch size. It holds up to that many values exactly; beyond, ranks are off by about 0.1 percent.
SKETCH = 4096
#: A sketch is asked for its values at this many evenly spaced ranks, enough to tell ``FITS`` values apart.
RANKS = 2048
FITS = RANKS // 2
#: How far from its position a cut is taken, as a share of the values still in question.
MARGIN = 0.002
#: Up to this many cuts are broadcast to the rows, beyond they meet by a shuffle join.
BROADCAST_CUTS = 100_000


def _sketch(column: Column) -> Column:
    return F.kll_sketch_agg_double(column, F.lit(SKETCH))


def _grid(sketch: str) -> Column:
    """Values of a sketch at the evenly spaced ranks; ranks must be constants, so they are written as one text."""
    ranks = ",".join(repr((step + 0.5) / RANKS) for step in range(RANKS))
    return F.kll_sketch_get_quantile_double(sketch, F.split(F.lit(ranks), ",").cast("array<double>"))


def _value_at(grid: Column, rank: Column) -> Column:
    """The grid's value nearest to a rank."""
    step = F.floor(F.least(F.greatest(rank, F.lit(0.0)), F.lit(1.0)) * RANKS).cast("int")
    return F.get(grid, F.least(step, F.lit(RANKS - 1)))


#: What is known of a wanted position: values strictly between ``after`` and ``before`` are still in question, ``left`` of
#: them with ``base`` values before them; ``low`` and ``high`` are the next cuts, ``value`` is found together with the ``next`` one.
KNOWN = ["_n", "_position", "_after", "_before", "_base", "_left", "_low", "_high", "_value", "_next"]


def _settled(state: DataFrame) -> DataFrame:
    """Take the value where the sketch behind ``_grid`` holds all that is left, else new cuts; no grid, no cuts."""
    offset, left, grid = F.col("_position") - F.col("_base"), F.col("_left"), F.col("_grid")
    asked = grid.isNotNull() & F.col("_value").isNull()
    fits = left <= FITS
    return state.withColumns(
        {
            "_value": F.coalesce("_value", F.when(asked & fits, _value_at(grid, (offset + 0.5) / left))),
            "_next": F.coalesce("_next", F.when(asked & fits, F.when(offset + 1 < left, _value_at(grid, (offset + 1.5) / left)).otherwise(F.col("_before")))),
            "_low": F.when(asked & ~fits, _value_at(grid, offset / left - MARGIN)),
            "_high": F.when(asked & ~fits, _value_at(grid, (offset + 1) / left + MARGIN)),
        }
    )


def _moved(counted: DataFrame) -> DataFrame:
    """Go on in the part that holds the position, or end at a cut that is the value."""
    low, high, base, left = (F.col(name) for name in ("_low", "_high", "_base", "_left"))
    upto = {"below": F.col("_below")}
    for name, before in (("lows", "below"), ("inside", "lows"), ("highs", "inside")):
        upto[name] = upto[before] + F.col(f"_{name}")
    offset, beyond = F.col("_position") - base, [F.col("_least_beyond"), F.col("_before")]
    part = F.when(low.isNull(), "uncut").when(offset < upto["below"], "below").when(offset < upto["lows"], "low")
    placed = counted.withColumn("_part", part.when(offset < upto["inside"], "inside").when(offset < upto["highs"], "high").otherwise("beyond"))
    pick = lambda stay, **parts: reduce(lambda chosen, item: chosen.when(F.col("_part") == item[0], item[1]), parts.items(), F.when(F.lit(False), stay)).otherwise(stay)
    return placed.select(
        *[name for name in placed.columns if name.startswith("_key")],
        "_target",
        "_n",
        "_position",
        pick(F.col("_after"), inside=low, beyond=high).alias("_after"),
        pick(F.col("_before"), below=low, inside=high).alias("_before"),
        pick(base, inside=base + upto["lows"], beyond=base + upto["highs"]).alias("_base"),
        pick(left, below=F.col("_below"), inside=F.col("_inside"), beyond=left - upto["highs"]).alias("_left"),
        F.when(F.col("_part") == "low", low).when(F.col("_part") == "high", high).alias("_value"),
        F.when(F.col("_part") == "low", F.when(offset + 1 < upto["lows"], low).otherwise(F.coalesce("_least_inside", F.when(F.col("_highs") > 0, high), *beyond)))
        .when(F.col("_part") == "high", F.when(offset + 1 < upto["highs"], high).otherwise(F.coalesce(*beyond)))
        .alias("_next"),
        # the sketch covers what lies between the cuts, or everything where there were none
        F.when(F.col("_part").isin("uncut", "inside"), F.col("_sketch")).alias("_sketch"),
    )


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per group, one column per entry of ``probabilities``.

    Nulls and NaN are left out, null group keys form a group. Without ``group`` there is one row, of nulls for
    no values. Values are compared as doubles.
    """
    keys = [f"_key{number}" for number in range(len(group) or 1)]
    named = [F.col(name).alias(key) for name, key in zip(group, keys)] or [F.lit(0).alias(keys[0])]
    v = F.col(value).cast("double")
    # -0.0 and 0.0 are one value
    rows = df.select(*named, (F.nanvl(v, F.lit(None).cast("double")) + F.lit(0.0)).alias("_v")).where(F.col("_v").isNotNull())
    first = rows.groupBy(*keys).agg(_sketch(F.col("_v")).alias("_sketch"), F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    places = {name: F.lit(float(p)) * (F.col("_n") - 1) for name, p in probabilities.items()}
    targets = F.array(*[F.struct(F.lit(number).alias("_target"), place.alias("_place")) for number, place in enumerate(places.values())])
    state = first.withColumn("_grid", _grid("_sketch")).select(*keys, "_n", "_min", "_max", "_grid", F.inline(targets))
    ends = F.when(F.col("_place") == 0, F.col("_min")).when(F.col("_place") == F.col("_n") - 1, F.col("_max"))
    nothing, zero = F.lit(None).cast("double"), F.lit(0).cast("long")
    state = state.withColumns({"_after": nothing, "_before": nothing, "_base": zero, "_left": F.col("_n"), "_value": ends, "_next": ends, "_position": F.floor("_place").cast("long")})
    finished = None
    while True:
        state = cut_lineage(_settled(state).select(*keys, "_target", *KNOWN))
        done = state.where("_value is not null").select(*keys, "_target", "_n", "_value", "_next")
        finished = done if finished is None else finished.unionByName(done)
        cuts = state.where("_value is null").select(*[F.col(key).alias(f"_of{key}") for key in keys], "_target", *KNOWN)
        many = cuts.count()
        if not many:
            break
        match = reduce(Column.__and__, [F.col(key).eqNullSafe(F.col(f"_of{key}")) for key in keys])
        v, low, high = F.col("_v"), F.col("_low"), F.col("_high")
        within = (F.col("_after").isNull() | (v > F.col("_after"))) & (F.col("_before").isNull() | (v < F.col("_before")))
        met = rows.join(F.broadcast(cuts) if many <= BROADCAST_CUTS else cuts, match & within)
        counted = met.groupBy(*keys, "_target").agg(
            F.any_value(F.struct(*KNOWN)).alias("_known"),
            F.count_if(v < low).alias("_below"),
            F.count_if(v == low).alias("_lows"),
            F.count_if((v > low) & (v < high)).alias("_inside"),
            F.count_if((v == high) & (high > low)).alias("_highs"),
            F.min(F.when((v > low) & (v < high), v)).alias("_least_inside"),
            F.min(F.when(v > high, v)).alias("_least_beyond"),
            _sketch(F.when(low.isNull() | (v > low) & (v < high), v)).alias("_sketch"),
        )
        state = _moved(counted.select("*", "_known.*")).withColumn("_grid", F.when(F.col("_value").isNull() & (F.col("_left") > 0), _grid("_sketch")))
    outputs = []
    for number, (name, place) in enumerate(places.items()):
        low, high = (F.max(F.when(F.col("_target") == number, F.col(found))) for found in ("_value", "_next"))
        part = F.max(place - F.floor(place))
        outputs.append(F.when(part == 0, low).otherwise(low * (1 - part) + high * part).alias(name))
    if not group:
        return finished.agg(*outputs)
    return finished.groupBy(*keys).agg(*outputs).select(*[F.col(key).alias(name) for key, name in zip(keys, group)], *probabilities)


def expected_scans(rows: int) -> int:
    """Scans that a group of ``rows`` values takes while no cut misses its position."""
    return 1 + max(0, math.ceil(math.log(max(rows / FITS, 1)) / -math.log(2 * MARGIN + 2 / RANKS)))
