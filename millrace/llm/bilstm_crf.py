"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Trained and run on batches of equally long windows of character classes.
Deterministic for a given seed and order of windows.
"""

from __future__ import annotations

import numpy as np

CLASSES = "@.+-()_%/:,;'\"#=|!?&*$[]{}"
#: 0 pads; then 26 letters without case, other letters, digits, blanks, line ends, the marks above, all else.
N_CLASSES = 32 + len(CLASSES)


def encode(text: str) -> np.ndarray:
    """The class of each character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(points, 256)]


_TABLE = np.full(257, 31, np.int64)
_TABLE[97:123] = _TABLE[65:91] = np.arange(1, 27)
_TABLE[0xC0:0x101] = 27
_TABLE[48:58] = 28
_TABLE[32], _TABLE[10], _TABLE[13] = 29, 30, 30
for _k, _x in enumerate(CLASSES):
    _TABLE[ord(_x)] = 32 + _k


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis, keepdims=True)
    return np.squeeze(most, axis) + np.log(np.exp(x - most).sum(axis))


class Tagger:
    def __init__(self, n_tags: int, hidden: int = 24, embed: int = 12, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) * (1.0 / np.sqrt(s[0]))).astype(np.float32)
        self.h = hidden
        self.p = {"E": 3 * f(N_CLASSES, embed), "O": f(2 * hidden, n_tags), "o": np.zeros(n_tags, np.float32), "T": np.zeros((n_tags, n_tags), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": f(embed, 4 * hidden), f"U{d}": f(hidden, 4 * hidden), f"b{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"b{d}"][hidden : 2 * hidden] = 1

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, batch, h) over x (steps, batch, embed), already in reading order."""
        h = self.h
        n, b, _ = x.shape
        inputs = x @ self.p[f"W{d}"] + self.p[f"b{d}"]
        out, s, c = np.empty((n, b, h), np.float32), np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
        for t in range(n):
            a = inputs[t] + s @ self.p[f"U{d}"]
            gates, g = _sigmoid(a[:, : 3 * h]), np.tanh(a[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            before, prior = c, s
            c = f * before + i * g
            tc = np.tanh(c)
            s = o * tc
            out[t] = s
            if keep is not None:
                keep.append((i, f, o, g, before, tc, prior))
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(batch, steps) classes to (steps, batch, tags) scores."""
        e = self.p["E"][x.T]
        both = np.concatenate([self._run(e, "f"), self._run(e[::-1], "b")[::-1]], 2)
        return both @ self.p["O"] + self.p["o"]

    def marginals(self, em: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log partition, tag marginals (steps, batch, tags), and summed pair marginals."""
        n = len(em)
        trans = self.p["T"]
        fwd, bwd = np.empty_like(em), np.zeros_like(em)
        fwd[0] = em[0]
        for t in range(1, n):
            fwd[t] = em[t] + _logsumexp(fwd[t - 1][:, :, None] + trans, 1)
        for t in range(n - 2, -1, -1):
            bwd[t] = _logsumexp(trans + (em[t + 1] + bwd[t + 1])[:, None, :], 2)
        z = _logsumexp(fwd[-1], 1)
        pairs = np.zeros_like(trans)
        for t in range(1, n):
            pairs += np.exp(fwd[t - 1][:, :, None] + trans + (em[t] + bwd[t])[:, None, :] - z[:, None, None]).sum(0)
        return z, np.exp(fwd + bwd - z[None, :, None]), pairs

    def decode(self, em: np.ndarray) -> np.ndarray:
        """The best tags, (steps, batch)."""
        n, b, k = em.shape
        back, score = np.empty((n, b, k), np.int8), em[0]
        for t in range(1, n):
            s = score[:, :, None] + self.p["T"]
            back[t] = s.argmax(1)
            score = em[t] + s.max(1)
        out = np.empty((n, b), np.int64)
        out[-1] = score.argmax(1)
        for t in range(n - 1, 0, -1):
            out[t - 1] = back[t][np.arange(b), out[t]]
        return out

    def _back(self, x: np.ndarray, d: str, keep: list, grad: np.ndarray, g: dict) -> np.ndarray:
        h = self.h
        dx, ds, dc = np.empty_like(x), 0.0, 0.0
        u = self.p[f"U{d}"]
        for t in range(len(x) - 1, -1, -1):
            i, f, o, c1, before, tc, prior = keep[t]
            dh = grad[t] + ds
            dct = dh * o * (1 - tc * tc) + dc
            da = np.concatenate([dct * c1 * i * (1 - i), dct * before * f * (1 - f), dh * tc * o * (1 - o), dct * i * (1 - c1 * c1)], 1)
            g[f"W{d}"] += x[t].T @ da
            g[f"U{d}"] += prior.T @ da
            g[f"b{d}"] += da.sum(0)
            dx[t] = da @ self.p[f"W{d}"].T
            ds, dc = da @ u.T, dct * f
        return dx

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 600, batch: int = 48, rate: float = 0.04) -> Tagger:
        """Adam on the CRF's negative log likelihood, the rate falling to a tenth; an epoch takes every window once. x, y: (windows, steps)."""
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        r, step = np.random.default_rng(11), 0
        while step < steps:
            order = r.permutation(len(x))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                xs, ys = x[own], y[own].T
                e = self.p["E"][xs.T]
                kf: list = []
                kb: list = []
                both = np.concatenate([self._run(e, "f", kf), self._run(e[::-1], "b", kb)[::-1]], 2)
                em = both @ self.p["O"] + self.p["o"]
                _, marginal, pairs = self.marginals(em)
                g = {k: np.zeros_like(v) for k, v in self.p.items()}
                d = marginal
                np.put_along_axis(d, ys[:, :, None], np.take_along_axis(d, ys[:, :, None], 2) - 1, 2)
                np.add.at(pairs, (ys[:-1].ravel(), ys[1:].ravel()), -1)
                g["T"], g["o"] = pairs, d.sum((0, 1))
                g["O"] = np.tensordot(both, d, ([0, 1], [0, 1]))
                dh = d @ self.p["O"].T
                de = self._back(e, "f", kf, dh[:, :, : self.h], g) + self._back(e[::-1], "b", kb, dh[::-1, :, self.h :], g)[::-1]
                np.add.at(g["E"], xs.T, de)
                step += 1
                now = rate * (1 - 0.9 * step / steps)
                for k, v in self.p.items():
                    grad = np.clip(g[k] / len(own), -1, 1)
                    a, b = m[k]
                    a += 0.1 * (grad - a)
                    b += 0.001 * (grad * grad - b)
                    v -= (now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                if step == steps:
                    break
        return self
