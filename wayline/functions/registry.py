"""A table of models by name that users add to, and networks over windows in numpy.

A model is built from its name and options and called on windows [n, channels,
samples]; it gives a mean and a log variance for each. ``register`` adds a class
under a name, once; ``build`` makes one. The networks here are for inference:
weights come in as arrays, by name.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

#: The bounds of a log variance (fixed values).
LOG_VARIANCE = (-8.0, 6.0)
_MODELS: dict[str, type] = {}


def register(name: str) -> Callable[[type], type]:
    """Adds a class of models under a name; a name that is taken raises."""

    def add(cls: type) -> type:
        if name in _MODELS:
            raise KeyError(f"model {name} is registered already")
        _MODELS[name] = cls
        return cls

    return add


def build(name: str, **options):
    if name not in _MODELS:
        raise KeyError(f"no model {name}; there are {sorted(_MODELS)}")
    return _MODELS[name](**options)


def names() -> list[str]:
    return sorted(_MODELS)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + _erf(x / math.sqrt(2)))


def _erf(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erf, otypes=[float])(x)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def conv(x: np.ndarray, w: np.ndarray, b: np.ndarray, left: int, right: int, dilation: int = 1) -> np.ndarray:
    """[n, out, samples] of a convolution; w: [out, in, kernel]; zeros to the left and right."""
    x = np.pad(x, ((0, 0), (0, 0), (left, right)))
    size = x.shape[2] - (w.shape[2] - 1) * dilation
    out = b[None, :, None] + np.zeros((len(x), w.shape[0], size))
    for k in range(w.shape[2]):
        out += np.einsum("oi,nis->nos", w[:, :, k], x[:, :, k * dilation : k * dilation + size])
    return out


def agreement(a: np.ndarray, b: np.ndarray, absolute: float = 1e-5, relative: float = 1e-4) -> dict[str, float | bool]:
    """How far two runs of a model are apart, and whether all of it is within |a - b| <= absolute + relative |b|."""
    gap = np.abs(a - b)
    return {"most": float(gap.max(initial=0.0)), "mean": float(gap.mean()) if gap.size else 0.0, "passes": bool((gap <= absolute + relative * np.abs(b)).all())}


def latency(model, window: np.ndarray, runs: int = 200, warmup: int = 20) -> dict[str, float]:
    """Milliseconds of a model on one window: median and 90th percentile after a warm-up."""
    import time

    times = []
    for k in range(warmup + runs):
        began = time.perf_counter()
        model(window)
        if k >= warmup:
            times.append((time.perf_counter() - began) * 1e3)
    return {"p50_ms": float(np.percentile(times, 50)), "p90_ms": float(np.percentile(times, 90))}


def smaller_batch(batch: int, least: int) -> tuple[int, bool]:
    """After a lack of memory: half the batch, and whether to leave the accelerator because the least is reached."""
    return (batch // 2, False) if batch // 2 >= least else (batch, True)


class Network:
    """Weights by name, drawn small where none are given, and the head that ends every network."""

    def __init__(self, channels: int, hidden: int = 16, positive: bool = False, weights: dict[str, np.ndarray] | None = None, seed: int = 0):
        self.hidden, self.positive, self.channels = hidden, positive, channels
        r = np.random.default_rng(seed)
        shapes = self.shapes() | {"head.w": (2, hidden), "head.b": (2,)}
        self.weights = {n: np.asarray(weights[n], float) if weights else r.normal(0, 1 / math.sqrt(max(1, math.prod(s[1:]))), s) * (len(s) > 1) for n, s in shapes.items()}
        wrong = [n for n, s in shapes.items() if self.weights[n].shape != s]
        if wrong:
            raise ValueError(f"weights of another shape: {wrong}")

    def shapes(self) -> dict[str, tuple[int, ...]]:
        raise NotImplementedError

    def features(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and log variance; positive: the mean through a softplus."""
        y = self.features(x) @ self.weights["head.w"].T + self.weights["head.b"]
        return (softplus(y[:, 0]) if self.positive else y[:, 0]), np.clip(y[:, 1], *LOG_VARIANCE)


@register("tcn")
class Causal(Network):
    """Dilated convolutions that see no later sample, with skips; the last sample's features count."""

    levels, kernel = 3, 3

    def shapes(self):
        out, c = {}, self.channels
        for k in range(self.levels):
            out |= {f"{k}.a.w": (self.hidden, c, self.kernel), f"{k}.a.b": (self.hidden,), f"{k}.b.w": (self.hidden, self.hidden, self.kernel), f"{k}.b.b": (self.hidden,)}
            if c != self.hidden:
                out |= {f"{k}.skip.w": (self.hidden, c, 1), f"{k}.skip.b": (self.hidden,)}
            c = self.hidden
        return out

    @property
    def reach(self) -> int:
        """Samples that the output looks at."""
        return 1 + 2 * (self.kernel - 1) * (2**self.levels - 1)

    def features(self, x):
        w = self.weights
        for k in range(self.levels):
            pad = (self.kernel - 1) * 2**k
            y = gelu(conv(x, w[f"{k}.a.w"], w[f"{k}.a.b"], pad, 0, 2**k))
            y = gelu(conv(y, w[f"{k}.b.w"], w[f"{k}.b.b"], pad, 0, 2**k))
            x = y + (conv(x, w[f"{k}.skip.w"], w[f"{k}.skip.b"], 0, 0) if f"{k}.skip.w" in w else x)
        return x[:, :, -1]


@register("cnn1d")
class Convolutional(Network):
    """Convolutions with a scale and shift of each channel, and the mean over all samples."""

    layers, kernel = 3, 5

    def shapes(self):
        out, c = {}, self.channels
        for k in range(self.layers):
            out |= {f"{k}.w": (self.hidden, c, self.kernel), f"{k}.b": (self.hidden,), f"{k}.scale": (self.hidden,), f"{k}.shift": (self.hidden,)}
            c = self.hidden
        return out

    def features(self, x):
        w = self.weights
        for k in range(self.layers):
            y = conv(x, w[f"{k}.w"], w[f"{k}.b"], self.kernel // 2, self.kernel // 2)
            x = gelu(y * (1 + w[f"{k}.scale"][None, :, None]) + w[f"{k}.shift"][None, :, None])
        return x.mean(axis=2)


class Recurrent(Network):
    """A light convolution, then gates over the samples; the last state's features count."""

    gates = 3

    def shapes(self):
        h, g = self.hidden, self.gates
        return {"in.w": (h, self.channels, 3), "in.b": (h,), "x.w": (g * h, h), "x.b": (g * h,), "h.w": (g * h, h), "h.b": (g * h,)}

    def features(self, x):
        w = self.weights
        y = gelu(conv(x, w["in.w"], w["in.b"], 1, 1))
        state = self.start(len(y))
        for k in range(y.shape[2]):
            state = self.turn(state, y[:, :, k] @ w["x.w"].T + w["x.b"], state[0] @ w["h.w"].T + w["h.b"])
        return state[0]

    def start(self, n: int) -> tuple[np.ndarray, ...]:
        return (np.zeros((n, self.hidden)),)

    def turn(self, state, a, b):
        raise NotImplementedError


@register("gru")
class Gated(Recurrent):
    def turn(self, state, a, b):
        (ra, za, na), (rb, zb, nb) = np.split(a, 3, axis=1), np.split(b, 3, axis=1)
        z = sigmoid(za + zb)
        return ((1 - z) * np.tanh(na + sigmoid(ra + rb) * nb) + z * state[0],)


@register("lstm")
class Memory(Recurrent):
    gates = 4

    def start(self, n):
        return np.zeros((n, self.hidden)), np.zeros((n, self.hidden))

    def turn(self, state, a, b):
        i, f, g, o = np.split(a + b, 4, axis=1)
        c = sigmoid(f) * state[1] + sigmoid(i) * np.tanh(g)
        return sigmoid(o) * np.tanh(c), c
