"""A bidirectional gated recurrent network over bytes, in numpy.

Every position of a window of bytes is labelled from a state that read the window up to it and one that
read it from its end. Training is by backpropagation through time. The input layer is a table
with a row for each byte, which stands for an embedding and its product with the input weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HIDDEN = 8


@dataclass
class Direction:
    """Gates z (keep), r (reset) and the new state n, side by side."""

    table: np.ndarray  # 256 x 3H, biases included
    recurrent: np.ndarray  # H x 3H
    out: np.ndarray  # H x L


@dataclass
class Network:
    forward: Direction
    backward: Direction
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [x for d in (self.forward, self.backward) for x in (d.table, d.recurrent, d.out)] + [self.bias]


def new_network(labels: int, hidden: int = HIDDEN, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)

    def direction() -> Direction:
        normal = lambda *shape: rng.normal(0, 0.3, shape).astype("f4")
        return Direction(normal(256, 3 * hidden), normal(hidden, 3 * hidden), normal(hidden, labels))

    return Network(direction(), direction(), np.zeros(labels, "f4"))


def _step(d: Direction, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """New state, gates z and r together, n, and the recurrent part of n."""
    hidden = h.shape[1]
    x, u = d.table[byte], h @ d.recurrent
    gates = np.tanh((x[:, : 2 * hidden] + u[:, : 2 * hidden]) * np.float32(0.5))
    gates += 1
    gates *= np.float32(0.5)
    m = u[:, 2 * hidden :]
    n = np.tanh(x[:, 2 * hidden :] + gates[:, hidden:] * m)
    return n + gates[:, :hidden] * (h - n), gates, n, m


def _softmax(logits: np.ndarray) -> np.ndarray:
    held = np.exp(logits - logits.max(-1, keepdims=True))
    return held / held.sum(-1, keepdims=True)


def label_windows(net: Network, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums over each window's positions of the labels' probabilities. ``windows``: rows of bytes, zero after their length."""
    count, width = windows.shape
    columns = np.ascontiguousarray(windows.T)
    masks = None if (lengths == width).all() else (np.arange(width)[:, None] < lengths)
    hidden, labels = net.forward.out.shape
    logits = np.empty((width, count, labels), "f4")
    h = np.zeros((count, hidden), "f4")
    for t in range(width):
        h = _step(net.forward, columns[t], h)[0]
        logits[t] = h @ net.forward.out
    h = np.zeros((count, hidden), "f4")
    sums = np.zeros((count, labels))
    for t in reversed(range(width)):
        h = _step(net.backward, columns[t], h)[0]
        if masks is not None:
            h *= masks[t][:, None]
        held = _softmax(logits[t] + h @ net.backward.out + net.bias)
        sums += held if masks is None else held * masks[t][:, None]
    return sums


def _run(d: Direction, columns: np.ndarray, order: range) -> tuple[dict[int, tuple], np.ndarray]:
    """What each step computed, with the state before it, and all states."""
    width, count = columns.shape
    states = np.empty((width, count, len(d.out)), "f4")
    h, seen = np.zeros((count, len(d.out)), "f4"), {}
    for t in order:
        new, gates, n, m = _step(d, columns[t], h)
        seen[t] = (h, gates, n, m)
        states[t] = h = new
    return seen, states


def _back(d: Direction, columns: np.ndarray, order: range, seen: dict[int, tuple], states: np.ndarray, d_logits: np.ndarray) -> list[np.ndarray]:
    """Gradients of table, recurrent and output weights: through the steps from the last to the first."""
    width, count = columns.shape
    hidden = len(d.out)
    d_recurrent, d_inputs = np.zeros_like(d.recurrent), np.empty((width, count, 3 * hidden), "f4")
    carried = np.zeros((count, hidden), "f4")
    for t in reversed(order):
        h, gates, n, m = seen[t]
        z, r = gates[:, :hidden], gates[:, hidden:]
        dh = carried + d_logits[t] @ d.out.T
        dn = dh * (1 - z) * (1 - n * n)
        d_gates = np.concatenate([dh * (h - n), dn * m], 1) * gates * (1 - gates)
        du = np.concatenate([d_gates, dn * r], 1)
        d_inputs[t] = np.concatenate([d_gates, dn], 1)
        d_recurrent += h.T @ du
        carried = dh * z + du @ d.recurrent.T
    order = np.argsort(columns, axis=None, kind="stable")
    sorted_bytes = columns.ravel()[order]
    firsts = np.flatnonzero(np.r_[True, sorted_bytes[1:] != sorted_bytes[:-1]])
    d_table = np.zeros_like(d.table)
    d_table[sorted_bytes[firsts]] = np.add.reduceat(d_inputs.reshape(-1, 3 * hidden)[order], firsts)
    return [d_table, d_recurrent, np.einsum("tbh,tbl->hl", states, d_logits)]


def gradients(net: Network, windows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy of all positions, and its gradients in the order of ``parameters``."""
    columns = np.ascontiguousarray(windows.T)
    width, count = columns.shape
    onward, backward = range(width), range(width - 1, -1, -1)
    seen_f, states_f = _run(net.forward, columns, onward)
    seen_b, states_b = _run(net.backward, columns, backward)
    held = _softmax(states_f @ net.forward.out + states_b @ net.backward.out + net.bias)
    rows = np.arange(count)
    loss = -np.log(np.maximum(held[:, rows, labels], 1e-12)).mean()
    held[:, rows, labels] -= 1
    held /= width * count
    found = _back(net.forward, columns, onward, seen_f, states_f, held)
    found += _back(net.backward, columns, backward, seen_b, states_b, held)
    return float(loss), [*found, held.sum((0, 1))]


def train(windows: np.ndarray, labels: np.ndarray, n_labels: int, steps: int, batch: int, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam on random batches; ``windows`` are rows of bytes, all of one length."""
    net, rng = new_network(n_labels, seed=seed), np.random.default_rng(seed)
    parameters = net.parameters()
    means, squares = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for step in range(1, steps + 1):
        chosen = rng.integers(0, len(windows), batch)
        _, found = gradients(net, windows[chosen], labels[chosen])
        decay = rate * (1 - (step - 1) / steps) + rate * 0.05
        for p, g, a, b in zip(parameters, found, means, squares, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (decay * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype("f4")
    return net
