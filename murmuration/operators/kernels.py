"""Numpy arithmetic of the networks, run on Arrow batches inside tasks."""

from __future__ import annotations

import numpy as np

# Hidden activations held at once, in doubles; keeps the working set near the size of a core's cache.
_WORKING_SET = 1 << 16


def _activate(z, kind):
    """In place.  ``tanh`` expects twice its argument: tanh(a) = 1 - 2 / (exp(2a) + 1)."""
    if kind == "tanh":
        np.exp(z, out=z)
        z += 1.0
        np.divide(-2.0, z, out=z)
        z += 1.0
    elif kind == "relu":
        np.maximum(z, 0.0, out=z)
    return z


def network_outputs(x, weights, hidden, output, layers, h):
    """Outputs of several networks on the same rows: ``x`` is (n, d), ``weights`` (m, w); gives (n, m)."""
    n, d = x.shape
    m = weights.shape[0]
    expected = h * (d + 1) if layers == 1 else h * (d + h + 1)
    if weights.shape[1] != expected:
        raise ValueError(f"{d} inputs and {h} hidden neurons need {expected} weights, found {weights.shape[1]}")
    scale = 2.0 if hidden == "tanh" else 1.0
    first = np.ascontiguousarray(weights[:, : h * d].reshape(m * h, d).T * scale)
    middle = weights[:, h * d : h * d + h * h].reshape(m, h, h) * scale if layers == 2 else None
    last = np.ascontiguousarray(weights[:, -h:])
    out = np.empty((n, m))
    step = max(1, _WORKING_SET // (m * h))
    with np.errstate(over="ignore"):
        for start in range(0, n, step):
            z = _activate(x[start : start + step] @ first, hidden).reshape(-1, m, h)
            if middle is not None:
                z = _activate(np.einsum("nmh,mjh->nmj", z, middle, optimize=True), hidden)
            out[start : start + step] = np.einsum("nmh,mh->nm", z, last)
        if output == "sigmoid":
            out = 1.0 / (1.0 + np.exp(-out))
    return out


def loss_parts(y, scores, loss, decision="threshold"):
    """Three additive parts of a loss per network, (m, 3); unused parts are zero."""
    parts = np.zeros((scores.shape[1], 3))
    truth = y[:, None]
    if loss == "mse":
        parts[:, 0] = np.square(truth - scores).sum(axis=0)
    elif loss == "bce":
        p = np.maximum(1e-15, np.minimum(1.0 - 1e-15, scores))
        parts[:, 0] = -(truth * np.log(p) + (1.0 - truth) * np.log(1.0 - p)).sum(axis=0)
    else:
        if decision == "signum":
            chosen = np.sign(scores)
        else:
            chosen = np.where(scores < 0.5, 0.0, 1.0)
        if loss == "error":
            parts[:, 0] = (chosen != truth).sum(axis=0)
        else:
            parts[:, 0] = ((truth == 1.0) & (chosen == 1.0)).sum(axis=0)
            parts[:, 1] = ((truth == 0.0) & (chosen == 1.0)).sum(axis=0)
            parts[:, 2] = ((truth == 1.0) & (chosen == 0.0)).sum(axis=0)
    return parts
