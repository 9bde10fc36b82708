"""Forward passes as Column expressions.

Readable and exact, but higher-order functions are interpreted per element: use these for small
networks and for checks, and ``operators.score`` for big tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmuration.functions.scalar import activate
from murmuration.functions.vectors import dot
from murmuration.network import Network


def _layer(inputs: Column, weights: Column, offset: int, n_in: int, n_out: int, kind: str) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_out - 1)),
        lambda j: activate(dot(inputs, F.slice(weights, F.lit(offset + 1) + j * F.lit(n_in), F.lit(n_in))), kind),
    )


def forward(x: Column, weights: Column, n_inputs: int, network: Network) -> Column:
    """Output of the network for one feature array and one weight array."""
    h = network.width(n_inputs)
    hidden = _layer(x, weights, 0, n_inputs, h, network.hidden)
    used = n_inputs * h
    if network.layers == 2:
        hidden = _layer(hidden, weights, used, h, h, network.hidden)
        used += h * h
    z = dot(hidden, F.slice(weights, used + 1, h))
    return activate(z, "sigmoid") if network.output == "sigmoid" else z
