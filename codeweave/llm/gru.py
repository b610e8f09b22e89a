"""A gated recurrent network in numpy with a class-factored softmax, trained by truncated backpropagation through time.

Units are frequent words and tail classes. P(unit | state) is P(class | state), a softmax over the classes of frequent words and the
tail classes, times P(word | class, state), a softmax within the class, for frequent words.
"""

from __future__ import annotations

import numpy as np


def row_sums(x: np.ndarray) -> np.ndarray:
    """Sums of short rows, by a matrix product, which is faster than a reduction."""
    return x @ np.ones(x.shape[1], x.dtype)


class Gru:
    """Units 0..words-1 are words, most frequent first, in classes of about equal frequency; units from `words` on are tail classes.
    Unit `end` ends a document, and as an input begins one from the zero state."""

    NAMES = ("wx", "wh", "wo", "bo", "wc", "bc")

    def __init__(self, words: int, tails: int, hidden: int, end: int, frequency: np.ndarray, classes: int = 8, seed: int = 1):
        r = np.random.default_rng(seed)
        self.words, self.units, self.hidden, self.end = words, words + tails, hidden, end
        f = np.asarray(frequency, np.float64) + 1.0
        share = np.sqrt(f[:words])
        bins = np.minimum((np.cumsum(share) - share) * classes / max(share.sum(), 1e-9), classes - 1).astype(np.int64)
        _, first = np.unique(bins, return_index=True)
        self.first = np.append(first, words).tolist()  # where each class of words begins
        n = len(first)
        self.of = np.concatenate([np.repeat(np.arange(n), np.diff(self.first)), n + np.arange(tails)]).astype(np.int64)
        mass = np.bincount(self.of, f, n + tails)
        self.wx = (r.standard_normal((self.units, 3 * hidden)) * 0.1).astype(np.float32)
        self.wh = (r.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.wo = (r.standard_normal((hidden, n + tails)) * 0.05).astype(np.float32)
        self.bo = np.log(mass / mass.sum()).astype(np.float32)
        self.wc = (r.standard_normal((hidden, words)) * 0.05).astype(np.float32)
        self.bc = np.log(f[:words] / mass[self.of[:words]]).astype(np.float32)
        self.mean, self.square = ({x: np.zeros_like(getattr(self, x)) for x in self.NAMES} for _ in range(2))
        self.step = 0.0

    def flat(self) -> np.ndarray:
        """Weights, both moments of the optimiser and its step, as one vector."""
        return np.concatenate([*[getattr(self, n).ravel() for n in self.NAMES], *[m[n].ravel() for m in (self.mean, self.square) for n in self.NAMES], np.array([self.step])]).astype(np.float64)

    def load(self, flat: np.ndarray) -> Gru:
        at = 0
        for put in (lambda n, x: setattr(self, n, x), self.mean.__setitem__, self.square.__setitem__):
            for n in self.NAMES:
                like = getattr(self, n)
                put(n, flat[at : at + like.size].reshape(like.shape).astype(np.float32))
                at += like.size
        self.step = float(flat[at])
        return self

    def cell(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        k = self.hidden
        gx, gh = self.wx[x], h @ self.wh
        gate = gx[:, : 2 * k] + gh[:, : 2 * k]
        np.negative(gate, out=gate)
        np.exp(gate, out=gate)
        gate += 1
        np.reciprocal(gate, out=gate)
        r, z = gate[:, :k], gate[:, k:]
        n = np.tanh(gx[:, 2 * k :] + r * gh[:, 2 * k :])
        return n + z * (h - n)

    def _within(self, c: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(first word, last word and one more, places) of the classes of several words among classes c."""
        order = np.argsort(c, kind="stable")
        at = np.searchsorted(c[order], np.arange(len(self.first)))
        return [(a, b, order[at[i] : at[i + 1]]) for i, (a, b) in enumerate(zip(self.first, self.first[1:], strict=False)) if b - a > 1 and at[i + 1] > at[i]]

    def log10_of(self, states: np.ndarray, y: np.ndarray) -> np.ndarray:
        """log10 of the chance of unit y after each state."""
        out = np.empty(len(y), np.float64)
        for at in range(0, len(y), 4096):
            h, u = states[at : at + 4096], y[at : at + 4096]
            c = self.of[u]
            o = h @ self.wo
            o += self.bo
            picked = o[np.arange(len(o)), c].astype(np.float64)
            np.exp(o, out=o)
            picked -= np.log(row_sums(o))
            for a, b, rows in self._within(c):
                o = h[rows] @ self.wc[:, a:b]
                o += self.bc[a:b]
                own = o[np.arange(len(rows)), u[rows] - a]
                np.exp(o, out=o)
                picked[rows] += own - np.log(row_sums(o))
            out[at : at + 4096] = picked / np.log(10)
        return out

    def score(self, documents: list[np.ndarray], window: int = 32) -> np.ndarray:
        """log10 probability of each whole document's units (which include the end): lanes run in step, the state goes on from window to window."""
        sizes = np.array([len(d) for d in documents], np.int64)
        order = np.argsort(-sizes, kind="stable")
        total = np.zeros(len(documents))
        if not len(documents):
            return total
        left = sizes[order]
        h = np.zeros((len(documents), self.hidden), np.float32)
        last = np.full(len(documents), self.end, np.int64)
        for t0 in range(0, int(left[0]), window):
            active = int(np.searchsorted(-left, -t0, side="left"))
            y = np.zeros((window, active), np.int64)
            for lane in range(active):
                part = documents[order[lane]][t0 : t0 + window]
                y[: len(part), lane] = part
            h, last = h[:active], last[:active]
            states, n = [], active
            for t in range(min(window, int(left[0]) - t0)):
                n = int(np.searchsorted(-left[:n], -(t0 + t), side="left"))
                h = self.cell(last[:n], h[:n])
                states.append(h)
                last = y[t, :n]
            got = self.log10_of(np.concatenate(states), np.concatenate([y[t, : len(s)] for t, s in enumerate(states)]))
            total[order[:active]] += np.bincount(np.concatenate([np.arange(len(s)) for s in states]), got, active)
        return total

    def _window(self, xs: np.ndarray, ys: np.ndarray, weight: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weighted log loss over a window, cut at its start, and the state after it."""
        k, steps, lanes = self.hidden, len(xs), xs.shape[1]
        kind = self.wh.dtype
        goes_on = (xs != self.end).astype(kind)[:, :, None]
        gates, n, ghn, before, states = np.empty((steps, lanes, 2 * k), kind), *(np.empty((steps, lanes, k), kind) for _ in range(4))
        gx = self.wx[xs]
        for t in range(steps):
            h0 = np.multiply(h, goes_on[t], out=before[t])
            gh = h0 @ self.wh
            gate = np.add(gx[t, :, : 2 * k], gh[:, : 2 * k], out=gates[t])
            np.negative(gate, out=gate)
            np.exp(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
            ghn[t] = gh[:, 2 * k :]
            new = np.multiply(gate[:, :k], ghn[t], out=n[t])
            new += gx[t, :, 2 * k :]
            np.tanh(new, out=new)
            h = np.subtract(h0, new, out=states[t])
            h *= gate[:, k:]
            h += new
        flat, y, w = states.reshape(-1, k), ys.ravel(), weight.ravel()
        c = self.of[y]
        p = np.exp(flat @ self.wo + self.bo)
        p *= (w / row_sums(p))[:, None]
        p[np.arange(len(p)), c] -= w
        d_out = p @ self.wo.T
        grads = {"wo": flat.T @ p, "bo": p.sum(axis=0), "wc": np.zeros_like(self.wc), "bc": np.zeros_like(self.bc)}
        for a, b, rows in self._within(c):
            own = flat[rows]
            q = np.exp(own @ self.wc[:, a:b] + self.bc[a:b])
            q *= (w[rows] / row_sums(q))[:, None]
            q[np.arange(len(rows)), y[rows] - a] -= w[rows]
            d_out[rows] += q @ self.wc[:, a:b].T
            grads["wc"][:, a:b] = own.T @ q
            grads["bc"][a:b] = q.sum(axis=0)
        d_out = d_out.reshape(steps, lanes, k)
        r, z = gates[:, :, :k], gates[:, :, k:]
        by = np.empty((steps, lanes, 3, k), kind)  # what a change of the state changes: reset gate, update gate, candidate
        down = (1 - z) * (1 - n * n)
        by[:, :, 2] = down * r
        by[:, :, 0] = by[:, :, 2] * ghn * (1 - r)
        by[:, :, 1] = (before - n) * z * (1 - z)
        d_all, d_gh = np.empty((steps, lanes, k), kind), by  # in place
        d, back = np.zeros((lanes, k), kind), np.ascontiguousarray(self.wh.T)
        for t in range(steps - 1, -1, -1):
            d = np.add(d, d_out[t], out=d_all[t])
            g = d_gh[t]
            g *= d[:, None]
            d = d * z[t]
            d += g.reshape(lanes, 3 * k) @ back
            d *= goes_on[t]
        d_gx = d_gh.reshape(steps, lanes, 3 * k).copy()
        np.multiply(d_all, down, out=d_gx[:, :, 2 * k :])
        x = xs.ravel()
        order = np.argsort(x, kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], x[order][1:] != x[order][:-1]]))
        grads["wx"] = np.zeros_like(self.wx)
        grads["wx"][x[order][begins]] = np.add.reduceat(d_gx.reshape(-1, 3 * k)[order], begins, axis=0)
        grads["wh"] = before.reshape(-1, k).T @ d_gh.reshape(-1, 3 * k)
        return grads, h.copy()

    def update(self, grads: dict[str, np.ndarray], rate: float) -> None:
        """One step of Adam, the gradient's length bounded."""
        self.step += 1
        scale = min(1.0, 1.0 / (float(np.sqrt(sum(float((g * g).sum()) for g in grads.values()))) + 1e-6))
        one, two = 1 - 0.9**self.step, 1 - 0.99**self.step
        for n, g in grads.items():
            g *= scale
            mean, square = self.mean[n], self.square[n]
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            w = getattr(self, n)
            w -= (rate / one) * mean / (np.sqrt(square / two) + 1e-6)


class Trainer:
    """Feeds documents to a network in `lanes` streams, a window of each at a time. What it learns hangs on the documents' order alone."""

    def __init__(self, net: Gru, rate: float, lanes: int, window: int = 16):
        self.net, self.rate, self.window, self.full = net, rate, window, lanes * window
        self.streams = [np.zeros(0, np.int64) for _ in range(lanes)]
        self.size = np.zeros(lanes, np.int64)
        self.last = np.full(lanes, net.end, np.int64)
        self.h = np.zeros((lanes, net.hidden), np.float32)
        self.seen = 0

    def feed(self, document: np.ndarray) -> None:
        i = int(self.size.argmin())
        self.streams[i] = np.concatenate([self.streams[i], document])
        self.size[i] += len(document)
        while self.size.min() >= self.window:
            self._go()

    def finish(self) -> int:
        """Learns from the rest; the number of units in all."""
        while (some := np.flatnonzero(self.size)).size:
            self.streams, self.size, self.last, self.h = [self.streams[i] for i in some], self.size[some], self.last[some], self.h[some]
            self._go()
        return self.seen

    def _go(self) -> None:
        # the last streams have longer windows, so that a very long document doesn't take very many small steps
        wide = min(8, self.full // (self.window * len(self.size)))
        steps = min(self.window * wide, int(self.size.max()))
        y = np.full((steps, len(self.size)), self.net.end, np.int64)
        for i, s in enumerate(self.streams):
            y[: min(steps, len(s)), i] = s[:steps]
            self.streams[i] = s[steps:]
        real = np.arange(steps)[:, None] < self.size
        x = np.vstack([self.last[None], y[:-1]])
        grads, self.h = self.net._window(x, y, real.astype(np.float32) / self.full, self.h)
        self.last = y[-1]
        self.net.update(grads, self.rate)
        self.size = np.maximum(self.size - steps, 0)
        self.seen += int(real.sum())
