"""A bidirectional LSTM that labels every step of a sequence, in numpy: inference, and training by Adam."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """hidden units each way; one logistic output for each step. Sequences are padded; masks tell steps from padding."""

    def __init__(self, inputs: int, hidden: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for way in "fb":
            self.p[way + "x"] = (r.normal(size=(inputs, 4 * hidden)) / np.sqrt(inputs)).astype(np.float32)
            self.p[way + "h"] = (r.normal(size=(hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, dtype=np.float32)
            bias[hidden : 2 * hidden] = 1  # remember at first
            self.p[way + "c"] = bias
        self.p["o"] = (r.normal(size=2 * hidden) * 0.3).astype(np.float32)
        self.p["ob"] = np.zeros(1, dtype=np.float32)

    def _scan(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool, state: tuple[np.ndarray, np.ndarray] | None = None):
        n, steps, _ = x.shape
        h, c = state or (np.zeros((n, self.hidden), dtype=np.float32),) * 2
        z = x @ self.p[way + "x"] + self.p[way + "c"]
        out = np.zeros((n, steps, self.hidden), dtype=np.float32)
        trace = []
        k = self.hidden
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            a = z[:, t] + h @ self.p[way + "h"]
            s = _sigmoid(a[:, : 3 * k])
            i, f, o, g = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :], np.tanh(a[:, 3 * k :])
            m = mask[:, t, None]
            nc = f * c + i * g
            tc = np.tanh(nc)
            if keep:
                trace.append((t, h, c, i, f, o, g, tc, m))
            c = np.where(m, nc, c)
            h = np.where(m, o * tc, h)
            out[:, t] = h
        return out, trace, (h, c)

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, b = (self._scan(x, mask, way, False)[0] for way in "fb")
        k = self.hidden
        return _sigmoid(f @ self.p["o"][:k] + b @ self.p["o"][k:] + self.p["ob"])

    def long_scores(self, part: Callable[[int, int], np.ndarray], steps: int, chunk: int) -> np.ndarray:
        """scores of one sequence, read in chunks by part(from, to); only a number for each step is kept of the whole."""
        k = self.hidden
        total = np.full(steps, self.p["ob"][0], dtype=np.float32)
        for way, head in (("f", self.p["o"][:k]), ("b", self.p["o"][k:])):
            state = None
            starts = range(0, steps, chunk)
            for a in starts if way == "f" else reversed(starts):
                x = part(a, min(steps, a + chunk))[None]
                out, _, state = self._scan(x, np.ones(x.shape[:2], dtype=bool), way, False, state)
                total[a : a + chunk] += out[0] @ head
        return _sigmoid(total)

    def _step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        k = self.hidden
        outs = {w: self._scan(x, mask, w, True) for w in "fb"}
        p = _sigmoid(outs["f"][0] @ self.p["o"][:k] + outs["b"][0] @ self.p["o"][k:] + self.p["ob"])
        d = np.where(mask, p - y, 0).astype(np.float32) / max(1, mask.sum())
        grad = {"o": np.concatenate([np.einsum("nt,ntk->k", d, outs[w][0]) for w in "fb"]), "ob": np.array([d.sum()])}
        for w, head in (("f", self.p["o"][:k]), ("b", self.p["o"][k:])):
            gx, gh, gc = (np.zeros_like(self.p[w + s]) for s in "xhc")
            dh = dc = np.zeros((len(x), k), dtype=np.float32)
            for t, h, c, i, f, o, g, tc, m in reversed(outs[w][1]):
                dh = dh + d[:, t, None] * head
                own, dc_own = np.where(m, dh, 0), np.where(m, dc, 0)
                do = own * tc
                dn = dc_own + own * o * (1 - tc * tc)
                da = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), do * o * (1 - o), dn * i * (1 - g * g)], axis=1)
                gx += x[:, t].T @ da
                gh += h.T @ da
                gc += da.sum(0)
                dh = np.where(m, da @ self.p[w + "h"].T, dh)
                dc = np.where(m, dn * f, dc)
            grad |= {w + "x": gx, w + "h": gh, w + "c": gc}
        return grad

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int = 20, size: int = 32, rate: float = 0.01, seed: int = 7) -> BiLstm:
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        at = 0
        for _ in range(epochs):
            order = r.permutation(len(sequences))
            for a in range(0, len(order), size):
                own = [sequences[j] for j in order[a : a + size]]
                x, mask = pad([s[0] for s in own])
                y = np.zeros(mask.shape, dtype=np.float32)
                for j, s in enumerate(own):
                    y[j, : len(s[1])] = s[1]
                at += 1
                for name, g in self._step(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    self.p[name] = (self.p[name] - rate * (first[name] / (1 - 0.9**at)) / (np.sqrt(second[name] / (1 - 0.999**at)) + 1e-8)).astype(np.float32)
        return self


def pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(1, max(len(r) for r in rows))
    x = np.zeros((len(rows), steps, rows[0].shape[1]), dtype=np.float32)
    mask = np.zeros((len(rows), steps), dtype=bool)
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
        mask[i, : len(r)] = True
    return x, mask
