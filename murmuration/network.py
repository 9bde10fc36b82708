"""Shape and activations of the networks.

Weights are one flat ``array<double>`` without biases.  With ``d`` inputs and ``h`` hidden neurons the
first neuron owns entries ``[0, d)``, the next ``[d, 2d)`` and so on; a second hidden layer, if any,
follows with ``h`` blocks of ``h`` entries; the last ``h`` entries feed the output.
"""

from __future__ import annotations

from dataclasses import dataclass

HIDDEN = ("identity", "tanh", "relu")
OUTPUT = ("linear", "sigmoid")


@dataclass(frozen=True)
class Network:
    hidden: str = "tanh"
    output: str = "linear"
    layers: int = 1
    n_hidden: int | None = None

    def __post_init__(self):
        if self.hidden not in HIDDEN:
            raise ValueError(f"hidden must be one of {HIDDEN}")
        if self.output not in OUTPUT:
            raise ValueError(f"output must be one of {OUTPUT}")
        if self.layers not in (1, 2):
            raise ValueError("layers must be 1 or 2")

    def width(self, n_inputs: int) -> int:
        """Hidden neurons per layer: as given, or 1.9 times the inputs rounded down."""
        return self.n_hidden if self.n_hidden is not None else int(1.9 * n_inputs)

    def n_weights(self, n_inputs: int) -> int:
        h = self.width(n_inputs)
        return h * (n_inputs + 1) if self.layers == 1 else h * (n_inputs + h + 1)


REGRESSOR = Network(hidden="tanh", output="linear")
LINEAR_REGRESSOR = Network(hidden="identity", output="linear")
CLASSIFIER = Network(hidden="relu", output="sigmoid")
DEEP_CLASSIFIER = Network(hidden="relu", output="linear", layers=2)
