"""Gated recurrent layers in numpy, with backpropagation through time.

Arrays are float32. Time runs along axis 0, the batch along axis 1.
"""

from __future__ import annotations

import numpy as np

F = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return F(0.5) * np.tanh(F(0.5) * x) + F(0.5)


def init(rng: np.random.Generator, hidden: int) -> np.ndarray:
    """Recurrent weights (hidden, 3 * hidden) in the order update, reset, new."""
    return (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(F)


def forward(gates: np.ndarray, u: np.ndarray, mask: np.ndarray | None, keep: bool = False):
    """States (T, B, H) for input projections ``gates`` (T, B, 3H).

    Where ``mask`` (T, B) is 0 the state is carried over. With ``keep`` also
    what the backward pass needs.
    """
    t_max, b, h3 = gates.shape
    n = h3 // 3
    h = np.zeros((b, n), dtype=F)
    out = np.empty((t_max, b, n), dtype=F)
    tape = []
    for t in range(t_max):
        g, p = gates[t], h @ u
        zr = sigmoid(g[:, : 2 * n] + p[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        new = np.tanh(g[:, 2 * n :] + r * p[:, 2 * n :])
        nxt = new + z * (h - new)
        if mask is not None:
            m = mask[t][:, None]
            nxt = h + m * (nxt - h)
        if keep:
            tape.append((h, z, r, new, p[:, 2 * n :]))
        h = nxt
        out[t] = h
    return (out, tape) if keep else out


def backward(d_out: np.ndarray, tape: list, u: np.ndarray, mask: np.ndarray | None):
    """Gradients for ``gates`` and ``u`` from those of the states."""
    t_max, b, n = d_out.shape
    d_gates = np.empty((t_max, b, 3 * n), dtype=F)
    d_u = np.zeros_like(u)
    d_h = np.zeros((b, n), dtype=F)
    for t in range(t_max - 1, -1, -1):
        h, z, r, new, p_new = tape[t]
        d = d_out[t] + d_h
        if mask is not None:
            m = mask[t][:, None]
            carried, d = d * (1 - m), d * m
        else:
            carried = 0
        d_new = d * (1 - z) * (1 - new * new)
        d_z = d * (h - new) * z * (1 - z)
        d_r = d_new * p_new * r * (1 - r)
        d_gates[t, :, :n], d_gates[t, :, n : 2 * n], d_gates[t, :, 2 * n :] = d_z, d_r, d_new
        d_p = np.concatenate([d_z, d_r, d_new * r], axis=1)
        d_u += h.T @ d_p
        d_h = d_p @ u.T + d * z + carried
    return d_gates, d_u


class Adam:
    """The usual adaptive-moment optimiser over a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 3e-3, clip: float = 1.0):
        self.p, self.rate, self.clip, self.t = params, rate, clip, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        scale = F(min(1.0, self.clip / (norm + 1e-9)))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += F(0.1) * (g - self.m[k])
            self.v[k] += F(0.01) * (g * g - self.v[k])
            mh = self.m[k] / F(1 - 0.9**self.t)
            vh = self.v[k] / F(1 - 0.99**self.t)
            self.p[k] -= F(self.rate) * mh / (np.sqrt(vh) + F(1e-8))


class Runner:
    """Inference of one direction, with separate contiguous gates.

    ``table`` (rows, 3H) holds the input projection of each input row. The
    scale of the logistic function, 0.5 tanh(x / 2) + 0.5, is folded in.
    """

    def __init__(self, table: np.ndarray, u: np.ndarray):
        n = u.shape[0]
        half = [F(0.5), F(0.5), F(1)]
        self.n = n
        self.e = [np.ascontiguousarray(table[:, i * n : (i + 1) * n] * half[i]) for i in range(3)]
        self.u = [np.ascontiguousarray(u[:, i * n : (i + 1) * n] * half[i]) for i in range(3)]

    def __call__(self, rows: np.ndarray, mask: np.ndarray | None = None, backwards: bool = False) -> np.ndarray:
        """States (T, B, H) for input rows (T, B), read from either end."""
        t_max, b = rows.shape
        n, (ez, er, en), (uz, ur, un) = self.n, self.e, self.u
        out = np.empty((t_max, b, n), dtype=F)
        h = np.zeros((b, n), dtype=F)
        z, r, w, p = (np.empty((b, n), dtype=F) for _ in range(4))
        for t in range(t_max - 1, -1, -1) if backwards else range(t_max):
            at = rows[t]
            np.matmul(h, uz, out=z)
            ez.take(at, axis=0, out=p, mode="clip")
            z += p
            np.tanh(z, out=z)
            np.matmul(h, ur, out=r)
            er.take(at, axis=0, out=p, mode="clip")
            r += p
            np.tanh(r, out=r)
            np.matmul(h, un, out=w)
            r += F(1)
            r *= F(0.5)
            r *= w
            en.take(at, axis=0, out=p, mode="clip")
            r += p
            np.tanh(r, out=r)  # the new state's proposal
            z += F(1)
            z *= F(0.5)
            np.subtract(h, r, out=w)
            w *= z
            if mask is None:
                np.add(r, w, out=out[t])
            else:
                r += w
                r -= h
                r *= mask[t][:, None]
                np.add(h, r, out=out[t])
            h = out[t]
        return out
