"""Linear recursions (recursive filters) in state-space form, run in blocks that need each other's last state alone."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Samples that are stepped through one by one; as many stretches of them as a block holds step together.
STRETCH = 256


@dataclass(frozen=True)
class Recursion:
    """state' = move @ state + enter * x; result = leave @ state + direct * x."""

    move: np.ndarray
    enter: np.ndarray
    leave: np.ndarray
    direct: float

    def over(self, length: int) -> np.ndarray:
        """What ``length`` samples of silence do to a state."""
        return np.linalg.matrix_power(self.move, length)

    def run(self, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The filtered samples and the state behind them.

        Stretches of the block run together from silence; their entry states follow from one prefix over the stretches, and each
        result is that from silence plus what its entry state adds.
        """
        state = np.zeros(len(self.enter)) if state is None else np.asarray(state, float)
        x = np.asarray(x, float)
        out = np.empty(len(x))
        length = STRETCH if len(x) >= STRETCH else max(1, len(x))
        n = len(x) // length
        if n:
            u, silent, result = x[: n * length].reshape(n, length), np.zeros((n, len(state))), np.empty((n, length))
            for t in range(length):
                result[:, t] = silent @ self.leave + self.direct * u[:, t]
                silent = silent @ self.move.T + u[:, t, None] * self.enter
            entry, across = np.empty((n, len(state))), self.over(length)
            for k in range(n):
                entry[k] = state
                state = across @ state + silent[k]
            heard, row = np.empty((length, len(state))), self.leave
            for t in range(length):
                heard[t], row = row, row @ self.move
            out[: n * length] = (result + entry @ heard.T).ravel()
        if len(x) > n * length:
            out[n * length :], state = self.run(x[n * length :], state)
        return out, state


    def run_rows(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """run() for the rows of a matrix, each with its own state: a step goes over all of them."""
        out = np.empty(x.shape)
        for t in range(x.shape[1]):
            out[:, t] = state @ self.leave + self.direct * x[:, t]
            state = state @ self.move.T + x[:, t, None] * self.enter
        return out, state

    def run_each(self, blocks: list[np.ndarray], states: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """run() for each block; short ones of one length together."""
        states = [np.zeros(len(self.enter))] * len(blocks) if states is None else states
        out, after, alike = [None] * len(blocks), [None] * len(blocks), {}
        for k, y in enumerate(blocks):
            if len(y) > STRETCH:
                out[k], after[k] = self.run(y, states[k])
            else:
                alike.setdefault(len(y), []).append(k)
        for ks in alike.values():
            rows, left = self.run_rows(np.stack([np.asarray(blocks[k], float) for k in ks]), np.stack([states[k] for k in ks]))
            for k, y, s in zip(ks, rows, left, strict=True):
                out[k], after[k] = y, s
        return out, after


def band_sections(low: float, high: float, order: int = 6) -> list[tuple[float, float, float]]:
    """Butterworth band-pass as sections (gain, a1, a2): gain (1 - z^-2) / (1 + a1 z^-1 + a2 z^-2). Edges are shares of half the
    sampling rate. Designed from the analog prototype; each section is scaled to 1 in mid-band."""
    warp = 4 * np.tan(np.pi * np.array([low, high]) / 2)
    width, center = warp[1] - warp[0], math.sqrt(warp[0] * warp[1])
    prototype = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * width / 2
    root = np.sqrt(prototype**2 - center**2)
    poles = np.concatenate([prototype + root, prototype - root])
    z = (4 + poles) / (4 - poles)
    middle = np.exp(1j * 2 * math.atan(center / 4))
    pairs = [(-2 * p.real, abs(p) ** 2) for p in sorted(z[z.imag > 0], key=abs)]
    return [(float(abs((middle**2 + a1 * middle + a2) / (middle**2 - 1))), float(a1), float(a2)) for a1, a2 in pairs]


def cascade(sections: list[tuple[float, float, float]]) -> Recursion:
    """The sections one behind the other, as one recursion with two numbers of state for each."""

    def step(state: np.ndarray, x: float) -> tuple[np.ndarray, float]:
        after = np.empty_like(state)
        for k, (gain, a1, a2) in enumerate(sections):
            scaled = gain * x
            x = scaled + state[2 * k]
            after[2 * k], after[2 * k + 1] = state[2 * k + 1] - a1 * x, -scaled - a2 * x
        return after, x

    size = 2 * len(sections)
    columns = [step(unit, 0.0) for unit in np.eye(size)]
    enter, direct = step(np.zeros(size), 1.0)
    return Recursion(np.stack([c for c, _ in columns], axis=1), enter, np.array([y for _, y in columns]), direct)
