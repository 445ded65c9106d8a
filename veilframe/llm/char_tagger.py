"""Character-level bidirectional LSTM with CRF transitions, in numpy: training, scores and best paths."""

from __future__ import annotations

import numpy as np

_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789@._%+-()[]{}\"'=:/\\ ,;#&$*!?|<>~\n"
#: inputs: the characters above with case folded, other letters, everything else
N_INPUTS = len(_CHARS) + 2
_TABLE = np.full(0x250, len(_CHARS), np.int64)
_TABLE[:128] = len(_CHARS) + 1
for _k, _c in enumerate(_CHARS):
    _TABLE[ord(_c)] = _TABLE[ord(_c.upper())] = _k


def inputs(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], len(_CHARS))


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class CharTagger:
    """Tags: 0 outside, 1 + 2k begins and 2 + 2k continues a span of kind k."""

    def __init__(self, kinds: tuple[str, ...], hidden: int = 16, seed: int = 7):
        self.kinds, self.hidden = kinds, hidden
        rng = np.random.default_rng(seed)
        k, h = 1 + 2 * len(kinds), hidden
        small = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0] if len(shape) > 1 and shape[0] < 100 else h), shape).astype(np.float32)
        self.p = {}
        for d in "fb":
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1  # forget gates start open
            self.p |= {f"x{d}": small(N_INPUTS, 4 * h), f"h{d}": small(h, 4 * h), f"b{d}": bias}
        self.p |= {"out": small(2 * h, k), "bias": np.zeros(k, np.float32), "step": np.zeros((k, k), np.float32), "start": np.zeros(k, np.float32)}
        allowed = np.ones((k, k), bool)
        for tag in range(2, k, 2):  # a span continues only what has begun
            allowed[:, tag] = False
            allowed[tag - 1, tag] = allowed[tag, tag] = True
        self.forbidden = np.where(allowed, 0, -1e4).astype(np.float32)

    def _run(self, idx: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, rows, hidden) of one direction; ``idx`` is (time, rows)."""
        h, n = self.hidden, idx.shape[1]
        wx, wh, b = self.p[f"x{d}"] + self.p[f"b{d}"], self.p[f"h{d}"], None
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out = np.empty((len(idx), n, h), np.float32)
        for t in range(len(idx)) if d == "f" else range(len(idx) - 1, -1, -1):
            z = wx[idx[t]] + state @ wh
            gates, new = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            before, before_state = cell, state
            cell = f * cell + i * new
            squashed = np.tanh(cell)
            state = o * squashed
            out[t] = state
            if keep is not None:
                keep.append((t, i, f, o, new, before, squashed, before_state))
        return out

    def scores(self, idx: np.ndarray) -> np.ndarray:
        """Tag scores (rows, time, tags) of windows (rows, time); both directions run at once, a gate's values lie together."""
        h, n, t_max = self.hidden, len(idx), idx.shape[1]
        kind = self.p["out"].dtype
        scale = np.array([0.5, 0.5, 0.5, 1], kind)[:, None, None]  # a sigmoid is a tanh of half its argument
        split = lambda w: w.reshape(-1, 4, h).transpose(1, 0, 2) * scale
        wx = [np.ascontiguousarray(split(self.p[f"x{d}"] + self.p[f"b{d}"])) for d in "fb"]
        wh = np.ascontiguousarray(np.stack([split(self.p[f"h{d}"]) for d in "fb"]))
        state, cell = np.zeros((2, n, h), kind), np.zeros((2, n, h), kind)
        out, z, given = np.empty((2, t_max, n, h), kind), np.empty((2, 4, n, h), kind), np.empty((2, 4, n, h), kind)
        idx = np.ascontiguousarray(idx.T)
        for t in range(t_max):
            at = (t, t_max - 1 - t)
            for d in (0, 1):
                np.take(wx[d], idx[at[d]], axis=1, out=given[d], mode="clip")
            np.matmul(state[:, None], wh, out=z)
            z += given
            np.tanh(z, out=z)
            z[:, :3] += 1
            z[:, :3] *= 0.5
            cell *= z[:, 1]
            z[:, 0] *= z[:, 3]
            cell += z[:, 0]
            np.tanh(cell, out=state)
            state *= z[:, 2]
            for d in (0, 1):
                out[d, at[d]] = state[d]
        e = out[0].reshape(-1, h) @ self.p["out"][:h] + out[1].reshape(-1, h) @ self.p["out"][h:] + self.p["bias"]
        return e.reshape(t_max, n, -1).transpose(1, 0, 2)

    def _crf(self, e: np.ndarray, gold: np.ndarray):
        """Loss and its gradients for scores (time, rows, tags) and tags (time, rows)."""
        t_max, n, k = e.shape
        step = self.p["step"] + self.forbidden
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = self.p["start"] + e[0]
        lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        for t in range(1, t_max):
            alpha[t] = lse(alpha[t - 1][:, :, None] + step, 1) + e[t]
        for t in range(t_max - 2, -1, -1):
            beta[t] = lse(step + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        d_e = np.exp(alpha + beta - z[:, None])
        pair = np.exp(alpha[:-1, :, :, None] + step + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None]).sum((0, 1))
        rows = np.arange(n)
        path = self.p["start"][gold[0]] + e[0, rows, gold[0]]
        for t in range(1, t_max):
            path = path + step[gold[t - 1], gold[t]] + e[t, rows, gold[t]]
        d_start = d_e[0].sum(0) - np.bincount(gold[0], minlength=k)
        np.subtract.at(d_e, (np.arange(t_max)[:, None], rows, gold), 1)
        np.subtract.at(pair, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        return float((z - path).mean()), d_e / n, pair / n, d_start / n

    def _gradients(self, idx: np.ndarray, gold: np.ndarray):
        idx, gold = idx.T, gold.T
        kept = {"f": [], "b": []}
        both = np.concatenate([self._run(idx, d, kept[d]) for d in "fb"], 2)
        loss, d_e, d_step, d_start = self._crf(both @ self.p["out"] + self.p["bias"], gold)
        h = self.hidden
        g = {"out": np.tensordot(both, d_e, ((0, 1), (0, 1))), "bias": d_e.sum((0, 1)), "step": d_step, "start": d_start}
        d_both = d_e @ self.p["out"].T
        for d, part in (("f", d_both[:, :, :h]), ("b", d_both[:, :, h:])):
            wh = self.p[f"h{d}"]
            g_x, g_h, g_b = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(wh), np.zeros(4 * h, np.float32)
            d_state, d_cell = np.zeros_like(part[0]), np.zeros_like(part[0])
            for t, i, f, o, new, before, squashed, before_state in reversed(kept[d]):
                d_s = part[t] + d_state
                d_cell = d_cell + d_s * o * (1 - squashed**2)
                dz = np.concatenate([d_cell * new * i * (1 - i), d_cell * before * f * (1 - f), d_s * squashed * o * (1 - o), d_cell * i * (1 - new**2)], 1)
                np.add.at(g_x, idx[t], dz)
                g_h += before_state.T @ dz
                g_b += dz.sum(0)
                d_state, d_cell = dz @ wh.T, d_cell * f
            g |= {f"x{d}": g_x, f"h{d}": g_h, f"b{d}": g_b}
        return loss, g

    def train(self, batches, n_batches: int, rate: float = 0.02) -> list[float]:
        """Adam over an iterable of ``n_batches`` (idx, gold), both (rows, time).

        The rate falls to zero over the second half and the weights are the mean of the last two fifths of the steps: at a
        constant rate the last step's weights differ with the rounding of a machine's products, and so do the spans.
        """
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        total, summed = {k: np.zeros(v.shape) for k, v in self.p.items()}, 0
        losses = []
        for n, (idx, gold) in enumerate(batches, 1):
            loss, g = self._gradients(idx, gold)
            losses.append(loss)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            now, late = rate * min(1.0, 2 * (1 - (n - 1) / n_batches)), n > 0.6 * n_batches
            for k in self.p:
                x = g[k] * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v2[k] = 0.99 * v2[k] + 0.01 * x * x
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**n)) / (np.sqrt(v2[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
                if late:
                    total[k] += self.p[k]
            summed += late
        if summed:
            self.p = {k: (v / summed).astype(np.float32) for k, v in total.items()}
        return losses

    def best_paths(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Viterbi tags (rows, time) for scores (rows, time, tags); rows beyond their size stay outside."""
        n, t_max, k = e.shape
        step = self.p["step"] + self.forbidden
        free = [0, *range(1, k, 2)]  # tags that may follow any other
        to_free, begun, going = step[:, free][:, :, None], step[range(1, k, 2), range(2, k, 2)][:, None], step[range(2, k, 2), range(2, k, 2)][:, None]
        best = np.ascontiguousarray(e.transpose(1, 2, 0))  # (time, tags, rows), summed up in place
        begin = self.p["start"].copy()
        begin[2::2] = -1e4
        best[0] += begin[:, None]
        for t in range(1, t_max):
            before, new = best[t - 1], best[t]
            x = (before[:, None] + to_free).max(0)
            new[0] += x[0]
            new[1::2] += x[1:]
            new[2::2] += np.maximum(before[1::2] + begun, before[2::2] + going)
            new -= new[0].copy()  # keeps sums small; only differences count
        tags = np.zeros((n, t_max), np.int8)
        after = np.concatenate([step.T, np.zeros((1, k), step.dtype)])  # the last row: nothing follows
        tag = np.full(n, k)
        for t in range(t_max - 1, -1, -1):
            tag = (best[t] + after[tag].T).argmax(0)
            tag[sizes <= t] = k
            tags[:, t] = tag
        tags[tags == k] = 0
        return tags
