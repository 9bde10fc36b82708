"""The steps of a particle swarm as DataFrame operators.

A swarm has one row per particle: ``*keys, pid, pos, vel, pbest, pbest_fit``.  During training each
group also has a row with ``pid = -1`` that carries the best position so far; being first in particle
order it takes part in every comparison, and an equal newcomer never replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.functions.draws import Draw, drawn_vector, hashed
from murmuration.functions.scalar import clamp

LEADER = -1
SPAN = 1 << 16  # particles of a group that one task walks through in order


def place_particles(groups: DataFrame, n_particles: int | Column) -> DataFrame:
    """One row per group and particle, numbered from zero in ``pid``."""
    count = n_particles if isinstance(n_particles, Column) else F.lit(n_particles)
    return groups.withColumn("pid", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)))


def init_swarm(groups: DataFrame, keys: list[str], n_particles: int | Column, n_weights: int, init_range: float,
               seed: int = 0, draw: Draw = hashed, draw_keys: list[str] | None = None,
               spread: bool = False) -> DataFrame:
    """Uniform positions and velocities in [-init_range, init_range); personal best is the start.

    ``spread`` distributes the particles, still narrow rows, before their vectors are drawn.
    """
    group = [F.col(k) for k in (draw_keys or keys)]
    placed = place_particles(groups, n_particles)
    if spread:
        placed = placed.repartition(*keys, "pid")
    return placed.select(
        *groups.columns,
        "pid",
        drawn_vector(draw, seed, group, F.col("pid"), n_weights, init_range).alias("pos"),
        drawn_vector(draw, seed, group, F.col("pid"), n_weights, init_range, first=n_weights).alias("vel"),
    ).withColumns({"pbest": F.col("pos"), "pbest_fit": F.lit(float("inf"))})


def personal_best() -> dict[str, Column]:
    """``pbest`` and ``pbest_fit`` after seeing ``fit``: replaced only where strictly better."""
    better = F.col("fit") < F.col("pbest_fit")
    return {
        "pbest": F.when(better, F.col("pos")).otherwise(F.col("pbest")),
        "pbest_fit": F.when(better, F.col("fit")).otherwise(F.col("pbest_fit")),
    }


def update_personal(swarm: DataFrame) -> DataFrame:
    return swarm.withColumns(personal_best())


def global_best(swarm: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, pos, fit`` of the best particle; the lowest ``pid`` wins ties."""
    order = F.struct("pbest_fit", "pid")
    return swarm.groupBy(*keys).agg(
        F.min_by("pbest", order).alias("pos"), F.min("pbest_fit").alias("fit")
    )


def best_seen(fits: DataFrame, keys: list[str], running: bool) -> DataFrame:
    """Add ``best_pid, best_fit`` of the group, or with ``running`` of the particles up to and including this one in
    ``pid`` order, and ``lead_pid, lead_fit`` of the group.

    ``fits`` has ``*keys, pid, pbest_fit`` and perhaps more; ``pid`` is a number that occurs once in a group, and no key
    is null.  Particles meet in spans of ``SPAN`` numbers; a window over one row per span carries the best so far from
    span to span, so a group of any size is split.
    """
    at = [*keys, "_span"]
    place = F.struct("pbest_fit", "pid")
    # One exchange serves the spans and the rows.
    dealt = fits.withColumn("_span", F.floor(F.col("pid") / F.lit(SPAN))).repartition(*at)
    group = Window.partitionBy(*keys)
    before = group.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = dealt.groupBy(*at).agg(F.min(place).alias("_least")).select(
        *at, F.min("_least").over(group).alias("_lead"), F.min("_least").over(before).alias("_before")
    )
    if running:
        inside = Window.partitionBy(*at).orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        dealt = dealt.withColumn("_inside", F.min(place).over(inside))
    best = F.least("_before", "_inside") if running else F.col("_lead")
    found = dealt.join(spans, at).withColumn("_best", best)
    return found.select(
        *fits.columns, F.col("_best.pid").alias("best_pid"), F.col("_best.pbest_fit").alias("best_fit"),
        F.col("_lead.pid").alias("lead_pid"), F.col("_lead.pbest_fit").alias("lead_fit"),
    )


def attach_best(swarm: DataFrame, keys: list[str], running: bool) -> DataFrame:
    """Add ``gbest`` and ``gbest_fit``; only the positions of the record holders travel."""
    seen = best_seen(swarm.select(*keys, "pid", "pbest_fit"), keys, running)
    holders = seen.select(*keys, F.col("best_pid").alias("pid")).distinct()
    positions = swarm.join(holders, [*keys, "pid"]).select(
        *keys, F.col("pid").alias("best_pid"), F.col("pbest").alias("gbest")
    )
    known = seen.select(*keys, "pid", "best_pid", F.col("best_fit").alias("gbest_fit"))
    led = swarm.join(known, [*keys, "pid"]).join(positions, [*keys, "best_pid"])
    return led.select(*swarm.columns, "gbest", "gbest_fit")


def pulls(c1: float, c2: float, seed: int, group: list[Column], step: int | Column, draw: Draw = hashed) -> Column:
    """The two random pull strengths of a particle in a step, as one array column."""
    at = step if isinstance(step, Column) else F.lit(step)
    pid = F.col("pid")
    return F.array(
        F.lit(float(c1)) * draw(seed, group, pid, F.lit(0), at),
        F.lit(float(c2)) * draw(seed, group, pid, F.lit(1), at),
    )


def new_velocity(inertia: float, v_max: float, social: str = "global") -> Column:
    """Velocity from ``pos, vel, pbest, gbest, pulls``, clamped to ``v_max``.

    ``social='personal'`` pulls twice towards the personal best and ignores the global one.
    """
    pos, own, pull = F.col("pos"), F.col("pbest"), F.col("pulls")
    lead = F.col("gbest") if social == "global" else own
    return F.transform(
        "vel",
        lambda v, k: clamp(
            F.lit(float(inertia)) * v + pull[0] * (own[k] - pos[k]) + pull[1] * (lead[k] - pos[k]), v_max
        ),
    )


def new_position(velocity: str, pos_max: float | None = None) -> Column:
    """Position plus velocity, clamped to ``pos_max`` if given."""
    if pos_max is None:
        return F.zip_with("pos", velocity, lambda p, v: p + v)
    return F.zip_with("pos", velocity, lambda p, v: clamp(p + v, pos_max))


def move(swarm: DataFrame, keys: list[str], step: int | Column, inertia: float, c1: float, c2: float, v_max: float,
         pos_max: float | None = None, social: str = "global", seed: int = 0, draw: Draw = hashed,
         draw_keys: list[str] | None = None) -> DataFrame:
    """Move every particle; needs ``gbest``.  One pair of draws per particle and step."""
    if social not in ("global", "personal"):
        raise ValueError("social must be 'global' or 'personal'")
    group = [F.col(k) for k in (draw_keys or keys)]
    rest = [c for c in swarm.columns if c not in ("pos", "vel")]
    return (
        swarm.withColumn("pulls", pulls(c1, c2, seed, group, step, draw))
        .select(*rest, "pos", new_velocity(inertia, v_max, social).alias("moved"))
        .select(*rest, new_position("moved", pos_max).alias("pos"), F.col("moved").alias("vel"))
    )
