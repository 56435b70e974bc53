"""A bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

import numpy as np

#: Rows of the tables of word and character-trigram vectors, their width, and units per direction.
WORD_ROWS, TRIGRAM_ROWS, WIDTH, UNITS = 1 << 15, 1 << 14, 24, 16


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def summed(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of the values of each row number from 0 to n - 1."""
    order = np.argsort(rows.astype(np.uint16) if n <= 1 << 16 else rows, kind="stable")
    own = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(own):
        out[own[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


class Words:
    """The inputs of some words: a row of the word table, and rows of the trigram table from starts[i] on."""

    def __init__(self, rows: np.ndarray, trigrams: np.ndarray, starts: np.ndarray):
        self.rows, self.trigrams, self.starts = rows, trigrams, starts
        self.counts = np.diff(np.concatenate([starts, [len(trigrams)]]))
        self.share = (1 / np.maximum(self.counts, 1)).astype(np.float32)

    def some(self, ids: np.ndarray) -> Words:
        """The inputs of some of these words."""
        counts = self.counts[ids]
        starts = np.cumsum(counts) - counts
        at = np.repeat(self.starts[ids] - starts, counts) + np.arange(counts.sum())
        return Words(self.rows[ids], self.trigrams[at], starts)


class Network:
    """Parameters, scores and gradients. Words come as rows of `projected`, windows as their numbers."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def normal(*shape: int, by: float) -> np.ndarray:
            return (rng.standard_normal(shape) * by).astype(np.float32)

        self.p = {
            "word": normal(WORD_ROWS, WIDTH, by=0.05),
            "trigram": normal(TRIGRAM_ROWS, WIDTH, by=0.1),
            "into": normal(WIDTH, 6 * UNITS, by=WIDTH**-0.5),
            "into_bias": np.zeros(6 * UNITS, np.float32),
            "forth": normal(UNITS, 3 * UNITS, by=UNITS**-0.5),
            "back": normal(UNITS, 3 * UNITS, by=UNITS**-0.5),
            "look": normal(2 * UNITS, by=0.3),
            "out": normal(2 * UNITS, by=0.3),
            "out_bias": np.full(1, -2, np.float32),
        }
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items() if k not in ("word", "trigram")}
        self.squares = {k: np.full(len(self.p[k]), 1e-2, np.float32) for k in ("word", "trigram")}
        self.steps = 0

    def vectors(self, w: Words) -> np.ndarray:
        """Word vector plus the mean of its trigrams' vectors."""
        sums = np.add.reduceat(self.p["trigram"][w.trigrams], w.starts, axis=0) if len(w.starts) else np.zeros((0, WIDTH), np.float32)
        return self.p["word"][w.rows] + sums * w.share[:, None]

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        """What the words put into the gates of both directions; worked out once for each word."""
        return vectors @ self.p["into"] + self.p["into_bias"]

    @staticmethod
    def _direction(g: np.ndarray, ids: np.ndarray, u: np.ndarray, order: range, keep: bool) -> tuple[np.ndarray, ...]:
        """The states of all steps and, if they are to be kept, the gates, the candidates and what the units put into these."""
        steps, n, h = ids.shape[1], len(ids), np.zeros((len(ids), UNITS), np.float32)
        states = np.empty((steps, n, UNITS), np.float32)
        each = steps if keep else 1
        zrs, cs, ans = np.empty((each, n, 2 * UNITS), np.float32), np.empty((each, n, UNITS), np.float32), np.empty((each, n, UNITS), np.float32)
        g_zr, g_c, u_zr, u_c = (np.ascontiguousarray(x) for x in (g[:, : 2 * UNITS], g[:, 2 * UNITS :], u[:, : 2 * UNITS], u[:, 2 * UNITS :]))
        a, columns = np.empty((n, 2 * UNITS), np.float32), np.ascontiguousarray(ids.T)
        for t in order:
            zr, c, an = (zrs[t], cs[t], ans[t]) if keep else (zrs[0], cs[0], ans[0])
            np.take(g_zr, columns[t], axis=0, out=zr, mode="clip")
            np.take(g_c, columns[t], axis=0, out=c, mode="clip")
            np.matmul(h, u_zr, out=a)
            np.matmul(h, u_c, out=an)
            zr += a  # 1 / (1 + exp(-x)), as the mean of 1 and tanh(x / 2)
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            c += zr[:, UNITS:] * an
            np.tanh(c, out=c)
            new = states[t]
            np.subtract(h, c, out=new)
            new *= zr[:, :UNITS]
            new += c
            h = new
        return states, zrs, cs, ans

    def forward(self, g: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows: ids are rows of g, mask tells which places hold a word."""
        steps = ids.shape[1]
        f = self._direction(g[:, : 3 * UNITS], ids, self.p["forth"], range(steps), keep is not None)
        b = self._direction(g[:, 3 * UNITS :], ids, self.p["back"], range(steps - 1, -1, -1), keep is not None)
        states = np.concatenate([f[0], b[0]], axis=2)
        look = np.where(mask.T, states @ self.p["look"], -1e9)
        look = np.exp(look - look.max(axis=0))
        look /= look.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", look, states)
        if keep is not None:
            keep.update(f=f, b=b, states=states, look=look, pooled=pooled)
        return pooled @ self.p["out"] + self.p["out_bias"][0]

    def learn(self, w: Words, ids: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray, rate: float) -> float:
        """One step of gradient descent on weighted cross entropy; ids are numbers of the words w."""
        vectors = self.vectors(w)
        g = self.projected(vectors)
        keep: dict = {}
        prob = sigmoid(self.forward(g, ids, mask, keep))
        loss = float(-(weight * (target * np.log(prob + 1e-7) + (1 - target) * np.log(1 - prob + 1e-7))).mean())
        d = ((prob - target) * weight / len(ids)).astype(np.float32)
        grads = {"out": keep["pooled"].T @ d, "out_bias": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * self.p["out"]
        states, look = keep["states"], keep["look"]
        s = np.einsum("tnh,nh->tn", states, dpool)
        dlook = look * (s - (look * s).sum(axis=0))
        grads["look"] = np.einsum("tn,tnh->h", dlook, states)
        dstates = look[:, :, None] * dpool + dlook[:, :, None] * self.p["look"]
        into_gates = np.empty((ids.shape[1], len(ids), 6 * UNITS), np.float32)
        for name, kept, part in (("forth", keep["f"], 0), ("back", keep["b"], 1)):
            own, zr, c, an = kept
            z, r, back = zr[:, :, :UNITS], zr[:, :, UNITS:], np.ascontiguousarray(self.p[name].T)
            h = np.zeros_like(own)  # the states before each step
            if part:
                h[:-1] = own[1:]
            else:
                h[1:] = own[:-1]
            # what doesn't depend on the later steps, for all steps at once
            by_c, by_z, by_r = (1 - z) * (1 - c * c), (h - c) * z * (1 - z), an * r * (1 - r)
            rec, dh = np.empty((len(ids), 3 * UNITS), np.float32), np.zeros((len(ids), UNITS), np.float32)
            gates = into_gates[:, :, part * 3 * UNITS : (part + 1) * 3 * UNITS]
            for t in range(len(own)) if part else range(len(own) - 1, -1, -1):
                dh += dstates[t][:, part * UNITS : (part + 1) * UNITS]
                dc = dh * by_c[t]
                np.multiply(dh, by_z[t], out=rec[:, :UNITS])
                np.multiply(dc, by_r[t], out=rec[:, UNITS : 2 * UNITS])
                np.multiply(dc, r[t], out=rec[:, 2 * UNITS :])
                gates[t][:, : 2 * UNITS] = rec[:, : 2 * UNITS]
                gates[t][:, 2 * UNITS :] = dc
                dh *= z[t]
                dh += rec @ back
            before = h.reshape(-1, UNITS)
            put = np.ascontiguousarray(gates)
            put[:, :, 2 * UNITS :] *= r  # the part of the units themselves
            grads[name] = before.T @ put.reshape(-1, 3 * UNITS)
        dg = summed(ids.T.ravel(), into_gates.reshape(-1, 6 * UNITS), len(g))
        grads["into"], grads["into_bias"] = vectors.T @ dg, dg.sum(axis=0)
        dv = dg @ self.p["into"].T
        self.steps += 1
        for k, grad in grads.items():
            m, v = self.moments[k]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            self.p[k] -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.99**self.steps)) + 1e-7)
        for k, rows, each in (("word", w.rows, dv), ("trigram", w.trigrams, np.repeat(dv * w.share[:, None], w.counts, axis=0))):
            at, where = np.unique(rows, return_inverse=True)
            total = summed(where, each, len(at))
            self.squares[k][at] += (total * total).mean(axis=1) * 1e4
            self.p[k][at] -= rate * 100 * total / np.sqrt(self.squares[k][at])[:, None]
        return loss
