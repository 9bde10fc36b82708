"""Murmuration: train, score and evaluate small neural networks on large tables by particle swarm.

Everything is a ``DataFrame``.  Plain expressions stay in Catalyst; only the dense arithmetic of the
network runs as numpy on Arrow batches inside tasks.
"""

import sys

from pyspark import cloudpickle

# Task-side helpers travel inside the pickled function, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from murmuration.network import Network  # noqa: E402
from murmuration.plans.evaluate import evaluate  # noqa: E402
from murmuration.plans.sweep import sweep  # noqa: E402
from murmuration.plans.train import SwarmSettings, Trained, fit  # noqa: E402

__all__ = ["Network", "SwarmSettings", "Trained", "evaluate", "fit", "sweep"]
