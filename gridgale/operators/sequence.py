"""Features that depend on the order of events in a disk: escalation, fatigue, gaps.

Events of a disk are ordered once inside each slice of time and summarised; a point then strings
the summaries of its window together with a running count. Nothing is collected into arrays, and
a busy cell is split by time, so no task holds more than one slice of one disk.

Slices are as wide as the tick. Where the edges of a disk's windows lie inside a slice (points may have
any time), they cut it there, into segments that each window holds whole or not at all. Times are doubled
here, so that a cut lies between two microseconds: an odd number just after a window's end, or just before
its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridgale.functions.clock import HOUR, common_step, floor_micros, micros, slice_mark
from gridgale.functions.hexgrid import offsets_array, on_tiles, tile_of, tile_offsets
from gridgale.operators.disk import grain_of
from gridgale.operators.range_join import served, serving_join

LOOKBACK_H = 72
MAX_SLICE_ROWS = 2_000_000
FEW_DISKS = 500_000


def suitable_width(weather: DataFrame, step: int, target: int = MAX_SLICE_ROWS) -> int:
    """The tick, or a divisor of it narrow enough that a slice of the busiest cell holds about
    ``target`` rows at most: one small aggregate, one number to the driver."""
    at = slice_mark(micros(F.col("event_time")), step)
    per_slice = weather.groupBy("q", "r", at.alias("at")).agg(F.count("*").alias("n"))
    busiest = per_slice.agg(F.max("n")).first()[0] or 0
    parts = 1
    while busiest > target * parts and parts < 2**20 and step % (parts * 2) == 0:
        parts *= 2
    return step // parts


def mark_of(t: Column, step: int) -> Column:
    """Doubled mark of the slice of ``t``."""
    return slice_mark(t, step) * 2


def window_cuts(points: DataFrame, step: int) -> DataFrame:
    """(q, r, slice, cut) of the window edges that lie inside a slice."""
    edges = F.array(
        F.struct(F.col("t").alias("x"), (F.col("t") * 2 + 1).alias("cut")),
        F.struct((F.col("t") - LOOKBACK_H * HOUR).alias("x"), ((F.col("t") - LOOKBACK_H * HOUR) * 2 - 1).alias("cut")),
    )
    cuts = points.select("q", "r", F.explode(edges).alias("e")).where(F.pmod("e.x", F.lit(step).cast("bigint")) != 0)
    return cuts.select("q", "r", mark_of(F.col("e.x"), step).alias("slice"), F.col("e.cut").alias("cut")).distinct()


def to_disks(rows: DataFrame, k: int, time: str, own: Column | None = None) -> DataFrame:
    """Rows of cells (q, r) copied to all disks that hold them, as (tq, tr, q, r); those with ``own`` only to the disk
    around their cell. Rows are sent once to each tile of disks: what is grouped by ``TILE_KEY`` is in place."""
    offsets = offsets_array(k)
    if own is not None:
        offsets = F.when(own, F.filter(offsets, lambda o: (o["dq"] == 0) & (o["dr"] == 0))).otherwise(offsets)
    out = on_tiles(rows, "q", "r", k, time).withColumn("_o", F.explode(tile_offsets(offsets, "q", "r")))
    return out.withColumns({"q": F.col("q") + F.col("_o.dq"), "r": F.col("r") + F.col("_o.dr")}).drop("_o")


TILE_KEY = ["tq", "tr", "slice", "q", "r"]


def segmented(events: DataFrame, step: int) -> DataFrame:
    """Rows of disks, cuts among them, with ``at`` moved to the last cut before them in their slice, if there is one.
    Cuts and events of a (disk, slice) are sorted together once."""
    w = Window.partitionBy(*TILE_KEY).orderBy("_when").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("kind") == CUT, F.col("_when"))).over(w)
    # Before the first cut, a segment is marked by its slice's start, which no window edge is in between.
    exact = F.pmod("_when", F.lit(2 * step).cast("bigint")) == 0
    start = F.when(exact, F.col("_when")).otherwise(floor_micros(F.col("slice"), 2 * step) + 1)
    placed = events.withColumn("_at", F.when(F.col("kind") == WANTED, F.col("at")).otherwise(F.coalesce(last, start)))
    return placed.where(F.col("kind") != CUT).withColumn("at", F.col("_at")).drop("_at")


def disk_counts(weather: DataFrame, step: int, k: int) -> DataFrame:
    """Events per (disk, slice), from counts per (cell, slice): no event is copied."""
    at = mark_of(micros(F.col("event_time")), step)
    per_cell = weather.groupBy("q", "r", at.alias("slice")).agg(F.count("*").alias("n"))
    counts = to_disks(per_cell, k, "slice").groupBy(*TILE_KEY).agg(F.sum("n").alias("n"))
    return counts.select("q", "r", F.col("slice").alias("at"), "n")


REACH = LOOKBACK_H * HOUR
# Segments are marked in doubled time; buckets are wide so that few segments are copied to two.
_WINDOW = {"before": 2 * REACH + 1, "width": 4 * REACH}


def in_window(points: DataFrame, segments: DataFrame, dealt: bool = False) -> DataFrame:
    """Points with the segments of their windows. ``bucket`` follows from ``t``."""
    return serving_join(points, segments, ["q", "r"], F.col("t") * 2, "at", dealt=dealt, **_WINDOW)


def half_cuts(points: DataFrame, counts: DataFrame) -> DataFrame:
    """Per point, where its first half of events ends: (q, r, t, n, cut_at, cut_i), the slice
    and the 0-based rank in it of the half's last event."""
    key = ["q", "r", "bucket", "t"]
    pairs = in_window(points, counts)
    w = Window.partitionBy(*key)
    placed = pairs.withColumns({
        "through": F.sum("n").over(w.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)),
        "half": F.floor(F.sum("n").over(w) / 2),
    })
    before = F.col("through") - F.col("n")
    is_cut = (before < F.col("half")) & (F.col("through") >= F.col("half"))
    return placed.groupBy(*key).agg(
        F.max(F.when(is_cut, F.col("at"))).alias("cut_at"),
        F.max(F.when(is_cut, F.col("half") - before - 1)).alias("cut_i"),
    )


CUT, WANTED, EVENT = 0, 1, 2


def disk_rows(weather: DataFrame, step: int, k: int, tie: str, disks: DataFrame | None = None,
              cutting: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Each event in every disk that holds it, with its slice and segment ``at``. With ``disks`` (q, r), which must be
    few, copies for other disks are dropped. ``cutting`` are the points whose window edges cut slices, if any does;
    ``wanted`` (q, r, at, ranks) come along as rows of their own."""
    rows = weather.select(
        F.lit(EVENT).alias("kind"), "q", "r",
        micros(F.col("event_time")).alias("t"),
        F.col(tie).alias("tie"),
        F.coalesce(F.col("magnitude"), F.lit(0.0)).alias("mag"),
        F.coalesce(F.col("damage_property"), F.lit(0.0)).alias("dmg"),
    ).withColumn("slice", mark_of(F.col("t"), step)).withColumn("at", F.col("slice"))
    if cutting is not None:
        marks = window_cuts(cutting, step).withColumnsRenamed({"cut": "_when"}).withColumn("kind", F.lit(CUT))
        rows = rows.withColumn("_when", F.col("t") * 2).unionByName(marks, allowMissingColumns=True)
    if wanted is not None:
        within = F.pmod("at", F.lit(2 * step).cast("bigint"))
        slice_of = F.when(within == 0, F.col("at")).otherwise(F.col("at") - within + 2 * (step // 2))
        wanted = wanted.withColumns({"slice": slice_of, "kind": F.lit(WANTED)})
        rows = rows.unionByName(wanted, allowMissingColumns=True)
    spread = to_disks(rows, k, "slice", F.col("kind") != EVENT)
    if disks is not None:
        spread = spread.join(F.broadcast(disks), ["q", "r"], "left_semi")
    return spread if cutting is None else segmented(spread, step).drop("_when")


def slice_summaries(rows: DataFrame) -> DataFrame:
    """One row per (disk, segment) of ``disk_rows`` with ``wanted``: the ranks at which some point's half ends. The
    running damage there is kept in ``dmg_at`` (a rank per point at most, so a few dozen). Events are ranked, and
    wanted ranks met, in one sort of the layout that the rows have."""
    key = [*TILE_KEY, "at"]
    w = Window.partitionBy(*key).orderBy("kind", "t", "tie")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    is_event = F.col("kind") == EVENT
    ordered = rows.withColumns({
        "i": F.count_if(is_event).over(so_far) - 1,
        "ranks": F.last("ranks", True).over(so_far),
        "prev_t": F.lag("t").over(w),
        "prev_mag": F.lag("mag").over(w),
        "dmg_through": F.sum("dmg").over(so_far),
    }).where(is_event)
    is_wanted = F.array_contains("ranks", F.col("i"))
    return ordered.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.sum("mag").alias("mag_sum"),
        F.sum(F.col("i") * F.col("mag")).alias("rank_mag_sum"),
        F.count_if(F.col("mag") > F.col("prev_mag")).alias("rises"),
        F.max(F.col("t") - F.col("prev_t")).alias("gap"),
        F.sum("dmg").alias("dmg_sum"),
        F.min("t").alias("first_t"),
        F.max(F.when(F.col("i") == 0, F.col("mag"))).alias("first_mag"),
        F.max("t").alias("last_t"),
        F.max_by("mag", "i").alias("last_mag"),
        F.map_from_entries(
            F.collect_list(F.when(is_wanted, F.struct("i", "dmg_through")))
        ).alias("dmg_at"),
    ).drop("tq", "tr", "slice")


def linked(summaries: DataFrame) -> DataFrame:
    """Segments dealt to the buckets whose points can see them, each with the events ``before`` it there and, from
    the one before, ``prev_at`` and what happens between the two. A window is a run of a disk's segments, so this
    is worked out once per segment and not once per point."""
    dealt = served(summaries, "at", _WINDOW["before"], 0, _WINDOW["width"])
    w = Window.partitionBy("q", "r", "bucket").orderBy("at")
    return dealt.withColumns({
        "before": F.coalesce(
            F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")
        ),
        "prev_at": F.lag("at").over(w),
        "step_gap": F.col("first_t") - F.lag("last_t").over(w),
        "step_rise": (F.col("first_mag") > F.lag("last_mag").over(w)).cast("bigint"),
    }).drop("first_t", "last_t", "first_mag", "last_mag")


def sequence_features(
    points: DataFrame,
    weather: DataFrame,
    tick: int,
    k: int = 2,
    tie: str = "event_id",
    slice_width: int | None = None,
    n_disks: int = 0,
    grain: int | None = None,
) -> DataFrame:
    """Order-dependent features per (q, r, t); ties in time are broken by ``tie``.

    A slice is as wide as the tick, or narrower where the busiest cell needs its events split over
    more tasks (``suitable_width``, unless the caller fixes ``slice_width``). ``n_disks``, when known, is
    about how many disks have points: few of them (16 bytes each) are broadcast to drop other copies early.

    The events of a disk are shuffled and sorted once. Where each point's first half of events
    ends follows from counts alone, so it is worked out beforehand and the running damage at
    that rank is picked up on the way.
    """
    step = common_step(tick, REACH)
    step = common_step(step, slice_width or suitable_width(weather, step))
    disks = points.select("q", "r").distinct() if 0 < n_disks <= FEW_DISKS else None
    if (grain or grain_of(points)) % step == 0:
        cutting = None
        counts = disk_counts(weather, step, k)
    else:
        cutting = points
        counts = disk_rows(weather, step, k, tie, disks, cutting).groupBy(*TILE_KEY, "at").agg(
            F.count("*").alias("n")).select("q", "r", "at", "n")
    cuts = half_cuts(points, counts)
    wanted = cuts.filter(F.col("cut_at").isNotNull()).groupBy("q", "r", "bucket", F.col("cut_at").alias("at")).agg(
        F.collect_set("cut_i").alias("ranks")
    ).groupBy("q", "r", "at").agg(F.array_distinct(F.flatten(F.collect_list("ranks"))).alias("ranks"))
    summaries = slice_summaries(disk_rows(weather, step, k, tie, disks, cutting, wanted))
    key = ["q", "r", "t"]
    pairs = in_window(cuts, linked(summaries), dealt=True)
    # The window's first segment has nothing of the window before it.
    follows = F.col("prev_at") >= F.col("t") * 2 - _WINDOW["before"]
    early_part = F.when(F.col("at") < F.col("cut_at"), F.col("dmg_sum")).when(
        F.col("at") == F.col("cut_at"), F.try_element_at("dmg_at", F.col("cut_i"))
    )
    totals = pairs.groupBy(*key, "bucket").agg(
        F.sum("n").alias("n"),
        F.sum("mag_sum").alias("mag_sum"),
        (F.sum(F.col("rank_mag_sum") + F.col("before") * F.col("mag_sum")) - F.min("before") * F.sum("mag_sum"))
        .alias("rank_mag_sum"),
        F.sum(F.col("rises") + F.when(follows, F.coalesce("step_rise", F.lit(0).cast("bigint"))).otherwise(0))
        .alias("rises"),
        F.max(F.greatest("gap", F.when(follows, F.col("step_gap")))).alias("gap"),
        F.sum("dmg_sum").alias("dmg_sum"),
        F.coalesce(F.sum(early_part), F.lit(0.0)).alias("dmg_first"),
    )

    n = F.col("n")
    # Weights run evenly from 0.5 to 1, so they sum to 0.75 n.
    fatigue = (
        F.col("mag_sum") * 0.5 + F.col("rank_mag_sum") * 0.5 / (n - 1)
    ) / (n * 0.75)
    early = F.col("dmg_first") / F.floor(n / 2)
    late = (F.col("dmg_sum") - F.col("dmg_first")) / (n - F.floor(n / 2))
    return totals.select(
        *key,
        n.cast("double").alias("seq_storm_count_72h"),
        F.when(n >= 2, F.col("rises") / (n - 1)).otherwise(0.0).alias("seq_escalation_score"),
        F.when(n > 1, fatigue).otherwise(0.0).alias("seq_infrastructure_fatigue"),
        F.when(n > 1, F.col("gap") / F.lit(float(HOUR))).otherwise(float(LOOKBACK_H))
        .alias("seq_max_gap_hours"),
        F.when(n >= 3, F.log1p(F.greatest(late, F.lit(0.0))) - F.log1p(early))
        .otherwise(0.0).alias("seq_damage_acceleration"),
    )
