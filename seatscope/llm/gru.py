"""A small bidirectional gated recurrent network over bytes, in numpy.

Every position of a byte window gets a distribution over classes from the states of a network that
reads forwards and one that reads backwards. Training is backpropagation through time with Adam.
Arrays are laid out features first, positions of many windows side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class GruParams:
    hidden: int = 8
    window: int = 128  # bytes read from a fresh state, in training and in use
    batch: int = 96
    steps: int = 400
    step_size: float = 0.02
    seed: int = 11
    windows_at_once: int = 2048


class Direction:
    """One reading direction: ``table`` holds the input part of the gates for each byte."""

    def __init__(self, table: np.ndarray, recurrent: np.ndarray) -> None:
        self.table, self.recurrent = table, recurrent
        self.hidden = recurrent.shape[1]

    def run(self, codes: np.ndarray, lengths: np.ndarray | None, order: range, keep: bool = False):
        """States by position, zero outside the window's bytes; ``keep`` also returns the gates."""
        hidden, width = self.hidden, codes.shape[1]
        states = np.empty((len(codes), hidden, width), np.float32)
        state, kept = np.zeros((hidden, width), np.float32), {}
        # sigmoid(x) = (1 + tanh(x / 2)) / 2, so one call serves the two gates.
        table, recurrent = self.table.copy(), self.recurrent.copy()
        table[: 2 * hidden] *= 0.5
        recurrent[: 2 * hidden] *= 0.5
        for t in order:
            inputs = table.take(codes[t], axis=1)
            past = recurrent @ state
            gates = inputs[: 2 * hidden]
            gates += past[: 2 * hidden]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            update, reset = gates[:hidden], gates[hidden:]
            new = inputs[2 * hidden :]
            if keep:
                kept[t] = [state, update, reset, past[2 * hidden :], new]
            new += reset * past[2 * hidden :]
            np.tanh(new, out=new)
            state = np.subtract(state, new, out=states[t])
            state *= update
            state += new
            if lengths is not None:
                state *= t < lengths
        return (states, kept) if keep else states

    def gradients(self, codes, kept, outside: np.ndarray, order: range) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and recurrent weights; ``outside`` is the gradient on each state."""
        hidden, (steps, width) = self.hidden, codes.shape
        on_gates = np.empty((steps, 3 * hidden, width), np.float32)
        on_recurrent = np.zeros_like(self.recurrent)
        later = np.zeros((hidden, width), np.float32)
        for t in reversed(order):
            state, update, reset, past, new = kept[t]
            total = outside[t] + later
            on_new = total * (1 - update) * (1 - new**2)
            on_update = total * (state - new) * update * (1 - update)
            on_reset = on_new * past * reset * (1 - reset)
            on_gates[t] = np.concatenate([on_update, on_reset, on_new])
            on_past = np.concatenate([on_update, on_reset, on_new * reset])
            on_recurrent += on_past @ state.T
            later = total * update + self.recurrent.T @ on_past
        flat = codes.ravel()
        by_gate = on_gates.transpose(1, 0, 2).reshape(3 * hidden, -1)
        on_table = np.stack([np.bincount(flat, row, 256) for row in by_gate]).astype(np.float32)
        return on_table, on_recurrent


class ByteTagger:
    """Class chances of every byte of a window."""

    def __init__(self, weights: list[np.ndarray]) -> None:
        self.weights = weights
        self.forward, self.backward = Direction(*weights[:2]), Direction(*weights[2:4])
        self.output, self.bias = weights[4:]

    @classmethod
    def fresh(cls, classes: int, params: GruParams) -> ByteTagger:
        rng, h = np.random.default_rng(params.seed), params.hidden
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        return cls([
            draw(3 * h, 256, scale=0.3), draw(3 * h, h, scale=h**-0.5),
            draw(3 * h, 256, scale=0.3), draw(3 * h, h, scale=h**-0.5),
            draw(classes, 2 * h, scale=0.3), np.zeros((classes, 1), np.float32),
        ])

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all positions, and its gradient for each array of weights."""
        steps, width = codes.shape
        ahead, kept_ahead = self.forward.run(codes, None, range(steps), keep=True)
        behind, kept_behind = self.backward.run(codes, None, range(steps)[::-1], keep=True)
        states = np.concatenate([ahead, behind], axis=1)
        logits = self.output @ states + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        chance = np.exp(logits)
        chance /= chance.sum(axis=1, keepdims=True)
        at = np.arange(width)
        loss = -np.log(np.maximum(chance[:, labels, at], 1e-9)).mean()
        chance[:, labels, at] -= 1
        chance /= steps * width
        on_output = np.einsum("tkb,thb->kh", chance, states, optimize=True)
        on_bias = chance.sum(axis=(0, 2))[:, None]
        on_states = self.output.T @ chance
        h = self.forward.hidden
        first = self.forward.gradients(codes, kept_ahead, on_states[:, :h], range(steps))
        second = self.backward.gradients(codes, kept_behind, on_states[:, h:], range(steps)[::-1])
        return float(loss), [*first, *second, on_output, on_bias]

    def window_sums(self, codes: np.ndarray, lengths: np.ndarray | None) -> np.ndarray:
        """Sum of the class chances over the positions of each window (classes x windows)."""
        steps, width = codes.shape
        ahead = self.forward.run(codes, lengths, range(steps))
        behind = self.backward.run(codes, lengths, range(steps)[::-1])
        h = self.forward.hidden
        left, right = np.ascontiguousarray(self.output[:, :h]), np.ascontiguousarray(self.output[:, h:])
        sums = np.zeros((len(self.bias), width), np.float32)
        for t in range(steps):
            chance = left @ ahead[t]
            chance += right @ behind[t]
            chance += self.bias
            np.exp(chance, out=chance)
            chance /= chance.sum(axis=0)
            sums += chance if lengths is None else chance * (t < lengths)
        return sums


def train(windows: np.ndarray, labels: np.ndarray, classes: int, params: GruParams) -> ByteTagger:
    """Learn from whole windows (rows of bytes) and the class of each."""
    model = ByteTagger.fresh(classes, params)
    rng = np.random.default_rng(params.seed)
    first = [np.zeros_like(w) for w in model.weights]
    second = [np.zeros_like(w) for w in model.weights]
    by_class = [np.flatnonzero(labels == c) for c in range(classes)]
    by_class = [rows for rows in by_class if len(rows)]
    for step in range(1, params.steps + 1):
        rows = np.concatenate([rng.choice(own, -(-params.batch // len(by_class))) for own in by_class])
        _, slopes = model.gradients(np.ascontiguousarray(windows[rows].T), labels[rows])
        norm = np.sqrt(sum(float((s**2).sum()) for s in slopes))
        rate = params.step_size * min(1.0, 2 * (1 - step / (params.steps + 1)))
        for w, slope, a, b in zip(model.weights, slopes, first, second):
            slope = slope / max(1.0, norm)
            a += 0.1 * (slope - a)
            b += 0.01 * (slope**2 - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return model
