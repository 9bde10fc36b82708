"""Hyper-parameter sweeps and comparison of convergence curves."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmuration.functions.draws import Draw, hashed
from murmuration.network import REGRESSOR, Network
from murmuration.operators.blocks import PackedTable, pack_blocks
from murmuration.operators.clean import Cut, at_cut, find_cut, up_to
from murmuration.operators.meeting import BROADCAST_BYTES
from murmuration.plans.train import SwarmSettings, Trained, train_runs


def _tagged(df: DataFrame, cuts: list[tuple[int, Cut]], order: str) -> DataFrame:
    """``df`` with ``tier``, the number of the first of the ascending ``cuts`` that includes the row."""
    tier = F.lit(len(cuts))
    for t, (_, cut) in reversed(list(enumerate(cuts))):
        tier = F.when(up_to(df, cut, order), F.lit(t)).otherwise(tier)
    split: dict[tuple, list[int]] = {}  # places where a limit ends among equal rows, with all limits that end there
    for t, (n, cut) in enumerate(cuts):
        split.setdefault((cut.value, cut.tie), []).append(t)
    split = {k: ts for k, ts in split.items() if any(cuts[t][1].before + cuts[t][1].there > cuts[t][0] for t in ts)}
    apart, rest = [], df
    for ts in split.values():
        cut = cuts[ts[0]][1]
        of = F.lit(ts[-1] + 1)
        for t in reversed(ts):
            of = F.when(F.col("rank") < cuts[t][0] - cut.before, F.lit(t)).otherwise(of)
        apart.append(at_cut(df, cut, order).withColumn("tier", of).drop("rank"))
        rest = rest.where(~up_to(df, cut, order, "="))
    return reduce(DataFrame.unionByName, apart, rest.withColumn("tier", tier))


def sweep(df: DataFrame, group: list[str], rows: list[int | None], iterations: list[int], particles: list[int],
          network: Network = REGRESSOR, loss: str = "mse", settings: SwarmSettings = SwarmSettings(),
          order: str = "row_id", draw: Draw = hashed, broadcast_bytes: int = BROADCAST_BYTES,
          **changes) -> Trained:
    """Train every combination of row limit, iterations and particles side by side.

    Row limits are nested prefixes in ``order`` (None is the whole table), exact also where they end among equal rows:
    each row is tagged once with the smallest limit that includes it, so the table is packed once whatever the number of
    runs.
    """
    settings = replace(settings, **changes)
    limits = sorted({n for n in rows if n is not None})
    cuts = [(n, find_cut(df, n, order)) for n in limits]
    cuts = [(n, c) for n, c in cuts if c is not None]
    whole = None in rows or len(cuts) < len(limits)
    tagged = _tagged(df, cuts, order)
    if not whole:
        tagged = tagged.where(F.col("tier") < len(cuts))
    table = PackedTable(pack_blocks(tagged, [*group, "tier"]), [*group, "tier"])
    try:
        tiers = {n: t for t, (n, _) in enumerate(cuts)}
        runs = [
            {
                "run_id": f"rows={n if n is not None else 'all'},iters={i},parts={p}",
                "iters": i,
                "parts": p,
                "tier": tiers.get(n, len(cuts)),
                "rows": n if n in tiers else table.n_rows,
            }
            for n, i, p in product(rows, iterations, particles)
        ]
        return train_runs(table, runs, group, network, loss, settings, draw=draw, broadcast_bytes=broadcast_bytes)
    finally:
        table.close()


def monotone_curve(fits: DataFrame, keys: list[str], order: str = "iter", fit: str = "fit") -> DataFrame:
    """Best fitness so far at every generation."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return fits.select(*keys, order, F.min(fit).over(window).alias("best_fitness"))


def stack_curves(curves: dict[str, DataFrame]) -> DataFrame:
    """The curves of several algorithms in one table with a column ``algo``."""
    stacked = None
    for algo, curve in curves.items():
        tagged = curve.withColumn("algo", F.lit(algo))
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    return stacked


def compare_curves(stacked: DataFrame, by: list[str]) -> DataFrame:
    """Per algorithm: first and best fitness, and the generation that first reached the best."""
    return stacked.groupBy("algo", *by).agg(
        F.min_by("best_fitness", "iter").alias("first_fitness"),
        F.min("best_fitness").alias("best_fitness"),
        F.min_by("iter", F.struct("best_fitness", "iter")).alias("reached_at"),
        F.count(F.lit(1)).alias("n_iters"),
    )
