"""A bidirectional LSTM over characters with a CRF on top, in numpy: training by Adam, batched Viterbi decoding.

Both directions run as one batch. Inputs are classes of characters (windows x length); tags are 0 for outside,
2k + 1 for the first and 2k + 2 for each further character of a span of kind k.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class BiLstmCrf:
    def __init__(self, classes: int, kinds: int, hidden: int = 16, seed: int = 5):
        rng, n = np.random.default_rng(seed), 2 * kinds + 1
        draw = lambda *shape: rng.normal(0, 0.25, shape).astype(np.float32)
        self.hidden, self.tags = hidden, n
        self.p = {"table": draw(2, classes, 4 * hidden), "loop": draw(2, hidden, 4 * hidden), "out": draw(2, hidden, n), "bias": np.zeros(n, np.float32), "step": np.zeros((n, n), np.float32)}
        self.p["table"][..., hidden : 2 * hidden] += 1  # forget little at first
        tag = np.arange(n)
        # the inside of a span follows its first character or its inside
        inside = (tag > 0) & (tag % 2 == 0)
        self.barred = np.where(inside[None] & (tag[:, None] != tag[None]) & (tag[:, None] + 1 != tag[None]), -1e4, 0).astype(np.float32)
        self.first_barred = np.where(inside, -1e4, 0).astype(np.float32)

    def _states(self, codes: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (2 x windows x length x hidden), the second direction's in its own order."""
        b, t = codes.shape
        h, c = np.zeros((2, b, self.hidden), np.float32), np.zeros((2, b, self.hidden), np.float32)
        out, trail, n = np.empty((t, 2, b, self.hidden), np.float32), [], self.hidden
        table, loop = self.p["table"], self.p["loop"]
        for k in range(t):
            z = np.stack([table[0][codes[:, k]], table[1][codes[:, t - 1 - k]]]) + h @ loop
            gate, g = _sigmoid(z[..., : 3 * n]), np.tanh(z[..., 3 * n :])
            before, h_before = c, h
            c = gate[..., n : 2 * n] * c + gate[..., :n] * g
            squashed = np.tanh(c)
            h = gate[..., 2 * n :] * squashed
            out[k] = h
            if keep:
                trail.append((gate, g, before, squashed, h_before))
        return out, trail

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """Score of each tag at each character (length x windows x tags)."""
        states, _ = self._states(codes, False)
        return states[:, 0] @ self.p["out"][0] + states[::-1, 1] @ self.p["out"][1] + self.p["bias"]

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of each window (windows x length), and by how much each character's tag beats being outside."""
        emit = self.emissions(codes)
        t, b, n = emit.shape
        step = self.p["step"] + self.barred
        best, back = emit[0] + self.first_barred, np.empty((t, b, n), np.int8)
        for k in range(1, t):
            all_ = best[:, :, None] + step
            back[k] = all_.argmax(1)
            best = np.take_along_axis(all_, back[k][:, None].astype(np.int64), 1)[:, 0] + emit[k]
        tags, rows = np.empty((b, t), np.int64), np.arange(b)
        tags[:, -1] = best.argmax(1)
        for k in range(t - 1, 0, -1):
            tags[:, k - 1] = back[k][rows, tags[:, k]]
        return tags, (np.take_along_axis(emit, tags.T[..., None], 2)[..., 0] - emit[..., 0]).T

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags and its gradients."""
        b, t = codes.shape
        n, p = self.hidden, self.p
        states, trail = self._states(codes, True)
        emit = states[:, 0] @ p["out"][0] + states[::-1, 1] @ p["out"][1] + p["bias"]
        step = p["step"] + self.barred
        ahead, behind = np.empty_like(emit), np.zeros_like(emit)
        ahead[0] = emit[0] + self.first_barred
        for k in range(1, t):
            ahead[k] = _logsumexp(ahead[k - 1][:, :, None] + step, 1) + emit[k]
        for k in range(t - 2, -1, -1):
            behind[k] = _logsumexp(step + (emit[k + 1] + behind[k + 1])[:, None], 2)
        total = _logsumexp(ahead[-1], 1)
        order, rows = tags.T, np.arange(b)
        gold = np.take_along_axis(emit, order[..., None], 2).sum() + step[order[:-1], order[1:]].sum()
        d_emit = np.exp(ahead + behind - total[:, None])
        both = np.exp(ahead[:-1, :, :, None] + step + (emit[1:] + behind[1:])[:, :, None] - total[:, None, None])
        d_step = both.sum((0, 1))
        np.subtract.at(d_step, (order[:-1].ravel(), order[1:].ravel()), 1)
        for k in range(t):
            d_emit[k, rows, order[k]] -= 1
        grad = {"bias": d_emit.sum((0, 1)), "step": d_step, "table": np.zeros_like(p["table"]), "loop": np.zeros_like(p["loop"])}
        seen = np.stack([states[:, 0], states[::-1, 1]])
        grad["out"] = np.einsum("dtbh,tbk->dhk", seen, d_emit)
        down = np.stack([d_emit @ p["out"][0].T, (d_emit @ p["out"][1].T)[::-1]], 1)  # each direction in its own order
        dh, dc = np.zeros((2, b, n), np.float32), np.zeros((2, b, n), np.float32)
        each = np.empty((t, 2, b, 4 * n), np.float32)
        for k in range(t - 1, -1, -1):
            gate, g, before, squashed, h_before = trail[k]
            dh = dh + down[k]
            dc = dc + dh * gate[..., 2 * n :] * (1 - squashed**2)
            dz = np.concatenate([dc * g, dc * before, dh * squashed], -1) * gate * (1 - gate)
            dz = np.concatenate([dz, dc * gate[..., :n] * (1 - g**2)], -1)
            grad["loop"] += h_before.transpose(0, 2, 1) @ dz
            each[k] = dz
            dh, dc = dz @ p["loop"].transpose(0, 2, 1), dc * gate[..., n : 2 * n]
        chosen = np.eye(p["table"].shape[1], dtype=np.float32)
        for d, own in enumerate((codes.T, codes.T[::-1])):
            grad["table"][d] = chosen[own.ravel()].T @ each[:, d].reshape(t * b, -1)
        return float((total.sum() - gold) / b), {k: v / b for k, v in grad.items()}

    def fit(self, codes: np.ndarray, tags: np.ndarray, steps: int = 260, batch: int = 48, rate: float = 0.02, seed: int = 9) -> BiLstmCrf:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for s in range(1, steps + 1):
            own = rng.integers(len(codes), size=batch)
            _, grad = self.gradients(codes[own], tags[own])
            norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            now = rate * min(1.0, 2.2 * (1 - s / (steps + 1)))
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g**2
                self.p[k] -= (now * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-6)).astype(np.float32)
        return self
