"""Windowed aggregates over the disk of cells around each prediction point.

The work is ordered so that its size follows the points and the grid, not the raw events:

1. raw rows collapse to one state per (cell, slice of time, category), combined map-side, so a
   cell that holds a third of all rows is a few hundred states by the time it is shuffled;
2. states are copied to the square tiles of cells whose points can see them, and to the buckets of time; points
   lie in the tile of their cell, in one bucket;
3. inside a (tile, bucket), each cell near a point, at the point's time, gathers its own states by a range join,
   and only those per-cell aggregates are copied to the points they belong to.

Which points a cell serves travels along as a bit mask over the disk offsets (19 bits for k = 2),
so step 3 needs no second join. All of it runs on the layout by tile and bucket (``PLACE``): only points and states
are shuffled, and requests, pairs and copies are made and summed up inside a task.

Points may have any time. States come in levels of ever narrower slices, down to single instants. A
window takes the widest slices that lie wholly inside it, and only in the slices that one of its edges
cuts, the next level's: a state counts from the window that holds it whole until the one that holds its
wider slice (``Level``). A cut slice is found by its number, so the lower levels are plain equi-joins and
touch a few slices per point. The states of an hour are nested in those of the tick, and met by the same join.
Where no edge cuts a slice (times on the tick), lower levels are not made.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgale.constants import (
    CATEGORIES,
    OUTAGE_LAGS_H,
    OUTAGE_TRENDS_H,
    WEATHER_WINDOWS_H,
)
from gridgale.functions.clock import HOUR, MINUTE, NEVER, common_step, floor_micros, micros, slice_mark
from gridgale.functions.hexgrid import disk_offsets, offsets_array, on_tiles, reached_tiles, tile_of, tile_offsets
from gridgale.functions.weather import category
from gridgale.operators.ordering import numbered
from gridgale.operators.range_join import bucket_of, served, serving_join

DISK_K = 2
NEIGHBOUR_WINDOW_H = 24
SPREAD_FRACTION = 0.01
WORD_BITS = 62  # event types in one mask
MAX_TYPES_IN_MASK = WORD_BITS * 8
GRAINS = (6 * HOUR, HOUR, 30 * MINUTE, MINUTE)


def distinct_points(points: DataFrame) -> DataFrame:
    """Distinct (q, r, t) of the points."""
    return points.select("q", "r", micros(F.col("ts")).alias("t")).distinct()


def off_grain(t: Column) -> Column:
    """How many times are off each of ``GRAINS``: an aggregate for ``grain_from``."""
    return F.array(*[F.count_if(F.pmod(t, F.lit(g).cast("bigint")) != 0) for g in GRAINS])


def grain_from(off: list[int]) -> int:
    """The widest of ``GRAINS`` that all times are multiples of; else one microsecond."""
    return next((g for g, n in zip(GRAINS, off, strict=True) if not n), 1)


def grain_of(points: DataFrame) -> int:
    """The grain of (q, r, t) points: one row to the driver."""
    return grain_from(points.agg(off_grain(F.col("t")).alias("off")).first()["off"])


@dataclass(frozen=True)
class Level:
    """States of slices ``step`` wide; below the first level, inside slices of ``parent``. Where ``parts`` is
    given, each state also holds the states of slices so wide that it is made of."""

    states: DataFrame
    step: int
    parent: int | None = None
    parts: int | None = None


def _extent(at: Column, step: int) -> tuple[Column, Column]:
    """First and last microsecond of the slice that ``at`` marks: an exact multiple, or what lies between two."""
    base = floor_micros(at, step)
    exact = at == base
    return F.when(exact, at).otherwise(base + 1), F.when(exact, at).otherwise(base + F.lit(step - 1).cast("bigint"))


def nested(states: DataFrame) -> Column:
    """An aggregate for ``Level.parts``: what the states hold besides their keys, for one slice as many as fit into it."""
    return F.collect_list(F.struct(*[F.col(c) for c in states.columns if c not in ("nq", "nr", "cat", "word")])).alias("parts")


def _whole_or_parts(found: DataFrame, level: Level, edges: list[int]) -> DataFrame:
    """Rows of the first level with ``lo`` and ``hi``; for a slice that a window edge cuts, the states it is made of."""
    if level.parts is None:
        return found.withColumns(dict(zip(("lo", "hi"), _extent(F.col("at"), level.step), strict=True)))
    base = floor_micros(F.col("at"), level.step)
    inside = [(F.col("t") - e > base) & (F.col("t") - e < base + F.lit(level.step).cast("bigint")) for e in edges]
    found = found.withColumn("_cut", (F.col("at") != base) & reduce(lambda a, b: a | b, inside))
    values = [f.name for f in found.schema["parts"].dataType.elementType.fields]
    whole = F.array(F.struct(*[F.col(c) for c in values]))
    rest = [c for c in found.columns if c not in (*values, "parts")]
    found = found.select(*rest, F.explode(F.when(F.col("_cut"), F.col("parts")).otherwise(whole)).alias("_e"))
    found = found.select(*rest, *[F.col(f"_e.{c}").alias(c) for c in values])
    wide, part = _extent(F.col("at"), level.step), _extent(F.col("at"), level.parts)
    return found.withColumns({
        name: F.when(F.col("_cut"), p).otherwise(w) for name, w, p in zip(("lo", "hi"), wide, part, strict=True)
    }).drop("_cut")


PLACE = ["tq", "tr", "bucket"]  # tile of cells and bucket of time: where points, requests and pairs lie


def bucket_width(reach: int, halved: int | None) -> int:
    """Buckets are as wide as the reach, with half a slice at either end where slices are met by their parts."""
    return reach + 2 * (halved // 2 if halved else 0)


def placed(points: DataFrame, width: int) -> DataFrame:
    """Rows (q, r, t, ...) with their ``PLACE`` for buckets that are ``width`` wide."""
    return points.withColumns({
        "tq": tile_of(F.col("q")), "tr": tile_of(F.col("r")), "bucket": bucket_of(F.col("t"), width),
    })


def dealt(states: DataFrame, t: str, k: int, before: int, after: int, width: int) -> DataFrame:
    """States once in each ``PLACE`` with points that can see them."""
    out = reached_tiles(states, "nq", "nr", k)
    return served(out, t, before, after, width).repartition(*PLACE)


def reaching(points: DataFrame, levels: list[Level], k: int, reach: int, edges: list[int],
             useful: Column | None = None) -> DataFrame:
    """States of all levels that the windows of the requests of ``points`` can hold: with ``old`` and ``new``, the
    greatest and least age in the state, and ``p_old`` and ``p_new``, those of the wider slice around it (null at the
    first level). All rows of a request lie in its ``PLACE``.

    ``edges`` are the ages of all window edges. ``useful`` tests rows of the first level.
    """
    age = {"lo": F.col("t") - F.col("lo"), "hi": F.col("t") - F.col("hi")}
    # A slice that an edge cuts may be marked just outside the reach, with parts inside.
    margin = levels[0].step // 2 if levels[0].parts else 0
    width = bucket_width(reach, levels[0].step if levels[0].parts else None)
    asked = requests(points, k, width)
    keys = ["tq", "tr", "nq", "nr"]
    out = None
    for level in levels:
        if level.parent is None:
            states = dealt(level.states, "at", k, reach + margin, margin, width)
            found = serving_join(asked, states, keys, F.col("t"), "at", reach + margin, margin, dealt=True)
            found = _whole_or_parts(found, level, edges).withColumns({"old": age["lo"], "new": age["hi"]})
            if useful is not None:
                found = found.where(useful)
            found = found.withColumns({"p_old": F.lit(None).cast("bigint"), "p_new": F.lit(None).cast("bigint")})
        else:
            lo, hi = _extent(F.col("at"), level.step)
            parent = F.lit(level.parent).cast("bigint")
            cut = F.array_distinct(F.filter(F.array(*[
                F.when(F.pmod(F.col("t") - e, parent) != 0, floor_micros(F.col("t") - e, level.parent)) for e in edges
            ]), lambda x: x.isNotNull()))
            inner = level.states.withColumns({"lo": lo, "hi": hi}).where(F.pmod("at", parent) != 0).withColumn(
                "_slice", floor_micros(F.col("at"), level.parent))
            inner = dealt(inner, "_slice", k, reach + level.parent, 0, width)
            # Most cut slices hold nothing: only those with states are looked up.
            used = inner.groupBy(*keys, "bucket").agg(F.collect_set("_slice").alias("_used"))
            found = asked.join(used.hint("merge"), [*keys, "bucket"])
            found = found.withColumn("_slice", F.explode(F.array_intersect(cut, "_used"))).drop("_used")
            found = found.join(inner.hint("merge"), [*keys, "bucket", "_slice"])
            found = found.withColumns({
                "old": age["lo"], "new": age["hi"], "p_old": F.col("t") - F.col("_slice") - 1,
                "p_new": F.col("t") - F.col("_slice") - (level.parent - 1),
            }).drop("_slice")
        found = found.drop("lo", "hi")
        out = found if out is None else out.unionByName(found)
    return out


def held(oldest: int, newest: int = 0, strict: bool = False) -> Column:
    """Whether a row of ``reaching`` counts for the window of ages from ``newest`` (left out if ``strict``) to
    ``oldest``: the state is inside and the slice around it is not."""
    def inside(old: str, new: str) -> Column:
        return (F.col(old) <= oldest) & (F.col(new) > newest if strict else F.col(new) >= newest)

    return inside("old", "new") & ~F.coalesce(inside("p_old", "p_new"), F.lit(False))


def requests(points: DataFrame, k: int, width: int) -> DataFrame:
    """(tq, tr, bucket, nq, nr, t, ring): cells whose history is needed at t by points of a tile, and for which
    offsets. Buckets of time are ``width`` wide."""
    out = placed(points, width).repartition(*PLACE).withColumn("_o", F.explode(offsets_array(k)))
    return out.groupBy(
        *PLACE, (F.col("q") + F.col("_o.dq")).alias("nq"), (F.col("r") + F.col("_o.dr")).alias("nr"), "t",
    ).agg(F.bit_or("_o.bit").alias("ring"))


REQUEST = [*PLACE, "nq", "nr", "t", "ring"]
POINT = ["tq", "tr", "q", "r", "t"]  # what per-cell rows at points are grouped by
PLACED_POINT = [*PLACE, "q", "r", "t"]  # the same for rows that lie in a place


def to_points(per_cell: DataFrame, k: int) -> DataFrame:
    """Copy per-cell rows to the points they serve, as (tq, tr, q, r, t, is_self, ...).

    Rows in a ``PLACE`` have the points of it in ``ring``, and stay there. Others go to the square tiles of cells that
    hold the points, once each; the copies for the points are made there. What is grouped by ``PLACED_POINT`` or
    ``POINT``, or more, then needs no shuffle.
    """
    offsets = offsets_array(k)
    if "tq" not in per_cell.columns:
        per_cell = on_tiles(per_cell, "nq", "nr", k, "t")
        offsets = tile_offsets(offsets, "nq", "nr", -1)
    wanted = F.filter(offsets, lambda o: F.col("ring").bitwiseAND(o["bit"]) != 0)
    out = per_cell.withColumn("_o", F.explode(wanted))
    return out.withColumns({
        "q": F.col("nq") - F.col("_o.dq"),
        "r": F.col("nr") - F.col("_o.dr"),
        "is_self": (F.col("_o.dq") == 0) & (F.col("_o.dr") == 0),
    }).drop("_o", "nq", "nr", "ring")


def event_vocabulary(weather: DataFrame) -> list[str] | None:
    """The event types in use, or None when there are too many to number in a bit mask."""
    rows = weather.select("event_type").distinct().limit(MAX_TYPES_IN_MASK + 1).collect()
    if len(rows) > MAX_TYPES_IN_MASK:
        return None
    return sorted(r["event_type"] for r in rows if r["event_type"] is not None)


def type_masks(event_type: Column, vocabulary: list[str]) -> dict[str, Column]:
    """One long per 62 types, with the bit of this row's type set."""
    masks = {}
    for w in range(0, max(len(vocabulary), 1), WORD_BITS):
        bits = {name: 1 << i for i, name in enumerate(vocabulary[w:w + WORD_BITS])}
        if bits:
            lookup = F.create_map(*[F.lit(x) for pair in bits.items() for x in pair])
            value = F.coalesce(F.try_element_at(lookup, event_type).cast("bigint"), F.lit(0).cast("bigint"))
        else:
            value = F.lit(0).cast("bigint")
        masks[f"m{w // WORD_BITS}"] = value
    return masks


# --- weather -----------------------------------------------------------------------------

def weather_states(weather: DataFrame, step: int, vocabulary: list[str]) -> DataFrame:
    """One row per (cell, slice, category): count, magnitudes, damage, types seen."""
    t = micros(F.col("event_time"))
    base = weather.select(
        F.col("q").alias("nq"), F.col("r").alias("nr"),
        slice_mark(t, step).alias("at"),
        F.coalesce(category(F.col("event_type")), F.lit("none")).alias("cat"),
        F.coalesce(F.col("magnitude"), F.lit(0.0)).alias("mag"),
        F.coalesce(F.col("damage_property"), F.lit(0.0)).alias("dmg"),
        *[c.alias(n) for n, c in type_masks(F.col("event_type"), vocabulary).items()],
    )
    masks = [c for c in base.columns if c.startswith("m") and c[1:].isdigit()]
    return base.groupBy("nq", "nr", "at", "cat").agg(
        F.count("*").alias("n"),
        F.max("mag").alias("mag_max"),
        F.sum("mag").alias("mag_sum"),
        F.sum("dmg").alias("dmg_sum"),
        *[F.bit_or(m).alias(m) for m in masks],
    )


def widened(states: DataFrame, width: int, *more: Column) -> DataFrame:
    """The same states merged to wider slices, with ``more`` aggregates."""
    masks = [c for c in states.columns if c.startswith("m") and c[1:].isdigit()]
    return states.groupBy("nq", "nr", slice_mark(F.col("at"), width).alias("at"), "cat").agg(
        F.sum("n").alias("n"), F.max("mag_max").alias("mag_max"),
        F.sum("mag_sum").alias("mag_sum"), F.sum("dmg_sum").alias("dmg_sum"),
        *[F.bit_or(m).alias(m) for m in masks], *more,
    )


def _weather_partials(masks: list[str]) -> list[Column]:
    # Windows end at the point's time, so one range of sizes says which windows a state counts for.
    def inside(w: int) -> Column:
        return (F.col("old") <= w * HOUR) & (F.col("until") > w * HOUR)

    out = []
    for w in WEATHER_WINDOWS_H:
        out += [
            F.sum(F.when(inside(w), F.col("n"))).alias(f"n_{w}"),
            F.max(F.when(inside(w), F.col("mag_max"))).alias(f"mx_{w}"),
            F.sum(F.when(inside(w), F.col("mag_sum"))).alias(f"sm_{w}"),
        ]
        out += [F.bit_or(F.when(inside(w), F.col(m))).alias(f"{m}_{w}") for m in masks]
    for c in CATEGORIES:
        active = inside(NEIGHBOUR_WINDOW_H) & (F.col("cat") == c)
        out += [
            F.sum(F.when(active, F.col("n"))).alias(f"cn_{c}"),
            F.max(F.when(active, F.col("mag_max"))).alias(f"cm_{c}"),
            F.sum(F.when(active, F.col("dmg_sum"))).alias(f"cd_{c}"),
        ]
    return out


def _or_zero(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def _weather_merge(masks: list[str], distinct_types: bool) -> list[Column]:
    out = []
    for w in WEATHER_WINDOWS_H:
        n, total = F.sum(f"n_{w}"), F.sum(f"sm_{w}")
        out += [
            _or_zero(n).alias(f"weather_count_{w}h"),
            _or_zero(F.max(f"mx_{w}")).alias(f"weather_max_mag_{w}h"),
            _or_zero(total / n).alias(f"weather_mean_mag_{w}h"),
        ]
        if distinct_types:
            bits = [F.coalesce(F.bit_count(F.bit_or(f"{m}_{w}")), F.lit(0)) for m in masks]
            out.append(_or_zero(reduce(lambda a, b: a + b, bits)).alias(f"weather_distinct_types_{w}h"))
    h = NEIGHBOUR_WINDOW_H
    other = ~F.col("is_self")
    n = F.sum(F.when(other, F.col(f"n_{h}")))
    out += [
        _or_zero(n).alias("neighbor_weather_count"),
        _or_zero(F.max(F.when(other, F.col(f"mx_{h}")))).alias("neighbor_weather_max_mag"),
        _or_zero(F.sum(F.when(other, F.col(f"sm_{h}"))) / n).alias("neighbor_weather_mean_mag"),
    ]
    for c in CATEGORIES:
        out += [
            F.greatest(_or_zero(F.max(f"cm_{c}")), F.lit(0.0)).alias(f"cat_{c}_max_magnitude"),
            _or_zero(F.sum(f"cd_{c}")).alias(f"cat_{c}_total_damage"),
            _or_zero(F.sum(f"cn_{c}")).alias(f"cat_{c}_event_count"),
        ]
    return out


def _halves(grain: int, tick: int) -> bool:
    """Whether window edges cut slices as wide as the tick, with hours to go down to."""
    return common_step(tick, HOUR) < tick and bool(grain % tick or any((w * HOUR) % tick for w in WEATHER_WINDOWS_H))


def weather_levels(grain: int, tick: int, states: Callable[[int], DataFrame], merged: Callable[..., DataFrame]) -> list[Level]:
    """Slices as wide as the tick, of an hour (nested in those), and instants: as far down as window edges cut
    slices."""
    hour = common_step(tick, HOUR)
    halves = _halves(grain, tick)
    least = hour if halves else tick
    instants = states(1) if grain % hour else None
    fine = states(least) if instants is None else merged(instants, least)
    first = Level(merged(fine, tick, nested(fine)), tick, None, hour) if halves else Level(fine, tick)
    return [first] if instants is None else [first, Level(instants, 1, least)]


def weather_width(grain: int, tick: int) -> int:
    """How wide the buckets of time are in which ``weather_aggregates`` finds its rows."""
    return bucket_width(max(WEATHER_WINDOWS_H) * HOUR, tick if _halves(grain, tick) else None)


def weather_pairs(points: DataFrame, levels: list[Level], k: int) -> DataFrame:
    edges = [0, *(w * HOUR for w in WEATHER_WINDOWS_H)]
    return reaching(points, levels, k, max(edges), edges).where("new >= 0")


def weather_aggregates(
    points: DataFrame,
    weather: DataFrame,
    tick: int,
    k: int = DISK_K,
    vocabulary: list[str] | None = None,
    grain: int | None = None,
    stay: bool = False,
) -> DataFrame:
    """Rolling, neighbour and per-category weather statistics per (q, r, t); with ``stay``, per ``PLACED_POINT``.

    Points with no event in reach are absent; the caller's left join fills them with zeros.
    ``vocabulary`` lists the event types, and ``grain`` is what all times are multiples of, when the caller
    knows them; else one scan each finds them.
    """
    grain = grain or grain_of(points)
    names = vocabulary if vocabulary is not None else event_vocabulary(weather)
    levels = weather_levels(grain, tick, lambda step: weather_states(weather, step, names or []), widened)
    masks = [c for c in levels[0].states.columns if c.startswith("m") and c[1:].isdigit()]
    pairs = weather_pairs(points, levels, k).withColumn(
        "until", F.when(F.col("p_new") >= 0, F.col("p_old")).otherwise(F.lit(-NEVER).cast("bigint"))
    )
    per_cell = pairs.groupBy(*REQUEST).agg(*_weather_partials(masks))
    merged = to_points(per_cell, k).groupBy(*PLACED_POINT).agg(
        *_weather_merge(masks, names is not None)
    )
    if names is None:
        types = distinct_type_counts(points, weather, tick, k, grain, stay=True)
        merged = merged.join(types.hint("merge"), PLACED_POINT, "left")
    return merged if stay else merged.drop(*PLACE)


def distinct_type_counts(
    points: DataFrame, weather: DataFrame, tick: int, k: int = DISK_K, grain: int | None = None, stay: bool = False
) -> DataFrame:
    """Distinct event types per window for a vocabulary of any size.

    Types are numbered, 62 to a word, and a state is one mask per (cell, slice, word), so what is copied to the points
    and grouped there grows with the words that a cell sees and not with its types.
    """
    rows = weather.filter(F.col("event_type").isNotNull())
    words = numbered(rows.select("event_type").distinct(), ["event_type"]).select(
        "event_type", F.floor(F.col("position") / WORD_BITS).cast("bigint").alias("word"),
        F.expr(f"shiftleft(1L, CAST(position % {WORD_BITS} AS INT))").alias("bit"),
    )
    rows = rows.join(words, "event_type")

    def types(step: int) -> DataFrame:
        at = slice_mark(micros(F.col("event_time")), step)
        return rows.groupBy(F.col("q").alias("nq"), F.col("r").alias("nr"), at.alias("at"), "word").agg(
            F.bit_or("bit").alias("bits"))

    levels = weather_levels(
        grain or grain_of(points), tick, types, lambda fine, step, *more: fine.groupBy(
            "nq", "nr", slice_mark(F.col("at"), step).alias("at"), "word").agg(F.bit_or("bits").alias("bits"), *more)
    )
    # A slice inside a window has no event older than the window; one that an edge cuts is met by its parts.
    # A state met at two levels sets the same bits twice.
    per_cell = weather_pairs(points, levels, k).groupBy(*REQUEST, "word").agg(*[
        F.bit_or(F.when(F.col("old") <= w * HOUR, F.col("bits"))).alias(f"bits_{w}") for w in WEATHER_WINDOWS_H
    ])
    per_word = to_points(per_cell, k).groupBy(*PLACED_POINT, "word").agg(*[
        F.bit_or(f"bits_{w}").alias(f"bits_{w}") for w in WEATHER_WINDOWS_H
    ])
    counts = per_word.groupBy(*PLACED_POINT).agg(*[
        _or_zero(F.sum(F.bit_count(f"bits_{w}"))).alias(f"weather_distinct_types_{w}h") for w in WEATHER_WINDOWS_H
    ])
    return counts if stay else counts.drop(*PLACE)


# --- outages -----------------------------------------------------------------------------

def outage_states(outages: DataFrame, step: int) -> DataFrame:
    at = slice_mark(micros(F.col("observed_at")), step)
    f = F.col("outage_fraction")
    return outages.groupBy(
        F.col("q").alias("nq"), F.col("r").alias("nr"), at.alias("at")
    ).agg(F.count(f).alias("n"), F.sum(f).alias("f_sum"), F.max(f).alias("f_max"))


def outage_aggregates(
    points: DataFrame, outages: DataFrame, tick: int, k: int = DISK_K, grain: int | None = None
) -> DataFrame:
    """Lagged means, half-window trends and neighbour outages per (q, r, t)."""
    near = max(*OUTAGE_TRENDS_H, NEIGHBOUR_WINDOW_H) * HOUR
    side = 30 * MINUTE
    reach = max(OUTAGE_LAGS_H) * HOUR + side
    step = common_step(tick, side)
    windows = {f"lag{lag}": (lag * HOUR + side, lag * HOUR - side) for lag in OUTAGE_LAGS_H}
    windows |= {f"late{w}": (w * HOUR // 2, 0) for w in OUTAGE_TRENDS_H}
    windows |= {f"early{w}": (w * HOUR, w * HOUR // 2) for w in OUTAGE_TRENDS_H}
    windows["day"] = (NEIGHBOUR_WINDOW_H * HOUR, 0)

    cut = (grain or grain_of(points)) % step != 0
    finest = outage_states(outages, 1 if cut else step)
    levels = [Level(finest, step)]
    if cut:
        wide = finest.groupBy("nq", "nr", slice_mark(F.col("at"), step).alias("at")).agg(
            F.sum("n").alias("n"), F.sum("f_sum").alias("f_sum"), F.max("f_max").alias("f_max"))
        levels = [Level(wide, step), Level(finest, 1, step)]
    # Between a day and a week back only the lag targets matter: the rest never leaves the join.
    useful = (F.col("new") >= 0) & (F.col("old") <= near)
    for oldest, newest in windows.values():
        if oldest > near:
            useful = useful | ((F.col("old") <= oldest) & (F.col("new") >= newest))
    edges = sorted({e for pair in windows.values() for e in pair})
    pairs = reaching(points, levels, k, reach, edges, useful)

    partials = []
    for name, (oldest, newest) in windows.items():
        test = held(oldest, newest, strict=name.startswith("early"))
        partials += [
            F.sum(F.when(test, F.col("n"))).alias(f"{name}_n"),
            F.sum(F.when(test, F.col("f_sum"))).alias(f"{name}_s"),
        ]
    partials.append(F.max(F.when(held(*windows["day"]), F.col("f_max"))).alias("day_x"))
    per_cell = pairs.groupBy(*REQUEST).agg(*partials)

    def mean(name: str) -> Column:
        return _or_zero(F.sum(f"{name}_s") / F.sum(f"{name}_n"))

    other = ~F.col("is_self")
    neighbours = len(disk_offsets(k)) - 1
    merged = [mean(f"lag{lag}").alias(f"lag_outage_{lag}h") for lag in OUTAGE_LAGS_H]
    merged += [
        (mean(f"late{w}") - mean(f"early{w}")).alias(f"trend_outage_{w}h") for w in OUTAGE_TRENDS_H
    ]
    merged += [
        _or_zero(
            F.sum(F.when(other, F.col("day_s"))) / F.sum(F.when(other, F.col("day_n")))
        ).alias("neighbor_outage_mean"),
        _or_zero(F.max(F.when(other, F.col("day_x")))).alias("neighbor_outage_max"),
        # One row per neighbouring cell here, so a count of rows is a count of cells.
        (
            F.count_if(other & (F.col("day_x") > SPREAD_FRACTION)).cast("double")
            / F.lit(float(max(neighbours, 1)))
        ).alias("neighbor_outage_spread"),
    ]
    return to_points(per_cell, k).groupBy(*PLACED_POINT).agg(*merged).drop(*PLACE)


def outage_labels(
    points: DataFrame, outages: DataFrame, tick: int, horizon_h: int = 24, leak_safe: bool = False,
    grain: int | None = None,
) -> DataFrame:
    """Worst outage above 1 % in the point's own cell within the next day, per (q, r, t).

    ``leak_safe`` leaves out an observation at exactly t, which the features also see.
    """
    span = horizon_h * HOUR
    step = common_step(tick, HOUR)
    low, high = F.col("t") + (1 if leak_safe else 0), F.col("t") + span

    def states(step: int) -> DataFrame:
        at = slice_mark(micros(F.col("observed_at")), step)
        return outages.filter(F.col("outage_fraction") > SPREAD_FRACTION).groupBy("q", "r", at.alias("at")).agg(
            F.max("outage_fraction").alias("worst"))

    first, last = _extent(F.col("at"), step)
    pairs = serving_join(points, states(step), ["q", "r"], F.col("t"), "at", 0, span).where(
        (first >= low) & (last <= high)).select("q", "r", "bucket", "t", "worst")
    if (grain or grain_of(points)) % step:
        # The two slices that an edge cuts, by instants; a worst value met twice does no harm.
        cut = points.withColumn("bucket", bucket_of(F.col("t"), span)).withColumn("_slice", F.explode(F.array_distinct(F.array(
            floor_micros(F.col("t"), step), floor_micros(high, step)))))
        exact = states(1).withColumn("_slice", floor_micros(F.col("at"), step))
        pairs = pairs.union(cut.join(exact.hint("merge"), ["q", "r", "_slice"]).where(F.col("at").between(low, high)).select(
            "q", "r", "bucket", "t", "worst"))
    return pairs.groupBy("q", "r", "bucket", "t").agg(F.max("worst").alias("worst")).drop("bucket")
