"""A bidirectional gated recurrent network over bytes in numpy, trained by backpropagation through time."""

from __future__ import annotations

import io

import numpy as np

BYTES = 256


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


class ByteGRU:
    """Two gated recurrent layers, one per direction, whose states give class scores at every byte.

    The byte embedding and the input weights are one table, so the input of a step is a lookup.
    Parameters: for each direction ``wx`` [256, 3h], ``u`` [h, 3h], ``b`` [3h], ``wo`` [h, classes]; one ``bo``."""

    def __init__(self, classes: list[str], hidden: int = 32, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes, self.hidden, h, c = list(classes), hidden, hidden, len(classes)
        self.p = {"bo": np.zeros(c, np.float32)}
        for d in "fb":
            self.p["wx" + d] = rng.normal(0, 0.3, (BYTES, 3 * h)).astype(np.float32)
            self.p["u" + d] = np.concatenate([np.linalg.qr(rng.normal(size=(h, h)))[0] for _ in range(3)], 1).astype(np.float32)
            self.p["b" + d] = np.zeros(3 * h, np.float32)
            self.p["wo" + d] = rng.normal(0, 0.3, (h, c)).astype(np.float32)

    # -- training ------------------------------------------------------------------------------
    def _both(self, name: str):
        """A parameter of both directions in one array."""
        return np.stack([self.p[name + "f"], self.p[name + "b"]])

    def loss(self, x, y):
        """Mean cross entropy over all positions of [T, B] bytes with labels [T, B] or [B], and its gradients.

        Both directions go through the steps together, as [2, B, h]; the gradients of the weights are summed after the steps, not within."""
        h, (steps, size) = self.hidden, x.shape
        wx, u, b, wo = (self._both(k) for k in ("wx", "u", "b", "wo"))
        both = np.stack([x, x[::-1]], 1).astype(np.intp)  # [T, 2, B]
        gx = wx.reshape(2 * BYTES, 3 * h)[both + np.array([0, BYTES])[:, None]]
        gx[..., : 2 * h] += b[:, None, : 2 * h]
        bn = b[:, None, 2 * h :]
        s = np.zeros((2, size, h), wx.dtype)
        before, gate, cand, inner, states = (np.empty((steps, 2, size, k * h), wx.dtype) for k in (1, 2, 1, 1, 1))
        for t in range(steps):
            gh = s @ u
            rz = _sigmoid(gx[t, :, :, : 2 * h] + gh[:, :, : 2 * h])
            gn = gh[:, :, 2 * h :] + bn
            n = np.tanh(gx[t, :, :, 2 * h :] + rz[:, :, :h] * gn)
            before[t], gate[t], cand[t], inner[t] = s, rz, n, gn
            s = states[t] = n + rz[:, :, h:] * (s - n)
        f, bw = states[:, 0], states[::-1, 1]
        scores = f @ wo[0] + bw @ wo[1] + self.p["bo"]
        scores -= scores.max(-1, keepdims=True)
        prob = np.exp(scores)
        prob /= prob.sum(-1, keepdims=True)
        count = x.size
        at = (np.arange(steps)[:, None], np.arange(size)[None, :], np.broadcast_to(y, x.shape))
        value = float(-np.log(prob[at] + 1e-12).sum() / count)
        prob[at] -= 1
        ds = prob / count
        flat = ds.reshape(count, -1)
        grads = {"bo": flat.sum(0), "wof": f.reshape(count, -1).T @ flat, "wob": bw.reshape(count, -1).T @ flat}
        dout = np.stack([ds @ wo[0].T, (ds @ wo[1].T)[::-1]], 1)
        r, z = gate[..., :h], gate[..., h:]
        keep, slope_n, slope_z, slope_r = 1 - z, 1 - cand * cand, z * (1 - z) * (before - cand), r * (1 - r) * inner
        dgx, dgh, ut = np.empty_like(gx), np.empty_like(gx), np.ascontiguousarray(u.transpose(0, 2, 1))
        carry = np.zeros_like(s)
        for t in range(steps - 1, -1, -1):
            g = dout[t] + carry
            dn = g * keep[t] * slope_n[t]
            d = dgh[t]
            np.multiply(dn, slope_r[t], out=d[:, :, :h])
            np.multiply(g, slope_z[t], out=d[:, :, h : 2 * h])
            np.multiply(dn, r[t], out=d[:, :, 2 * h :])
            dgx[t, :, :, 2 * h :] = dn
            carry = g * z[t] + d @ ut
        dgx[..., : 2 * h] = dgh[..., : 2 * h]
        for k, d in enumerate("fb"):
            rows = dgh[:, k].reshape(count, -1)
            grads["u" + d], grads["b" + d] = before[:, k].reshape(count, -1).T @ rows, rows.sum(0)
            grads["wx" + d] = np.zeros_like(wx[k])
            byte = both[:, k].ravel()
            order = np.argsort(byte, kind="stable")
            found, first = np.unique(byte[order], return_index=True)
            grads["wx" + d][found] = np.add.reduceat(dgx[:, k].reshape(count, -1)[order], first, 0)
        return value, grads

    def fit(self, texts: list[bytes], labels: list[int], steps: int, width: int = 48, batch: int = 64, rate: float = 0.01, seed: int = 1, weights=None, mixed: float = 0.3) -> float:
        """Adam on random cuts of ``width`` bytes of texts drawn by their weights; returns the mean loss of the last steps.

        A share ``mixed`` of the cuts goes over from one text to another at a random place, so that
        positions are labelled by what is near them and a change of class is seen."""
        rng = np.random.default_rng(seed)
        arrays = [np.frombuffer(t, np.uint8) if len(t) >= width else np.frombuffer((t + b" ") * (width // (len(t) + 1) + 1), np.uint8) for t in texts]
        y_all = np.asarray(labels)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        last = []
        upto = np.cumsum(np.ones(len(arrays)) if weights is None else np.asarray(weights, float))
        for step in range(1, steps + 1):
            pick = np.searchsorted(upto, rng.random(batch) * upto[-1], side="right").clip(0, len(arrays) - 1)
            other = np.searchsorted(upto, rng.random(batch) * upto[-1], side="right").clip(0, len(arrays) - 1)
            x, y = np.empty((width, batch), np.uint8), np.empty((width, batch), np.int64)
            for j, i in enumerate(pick):
                a = arrays[i]
                at = rng.integers(0, len(a) - width + 1)
                x[:, j], y[:, j] = a[at : at + width], y_all[i]
                if rng.random() < mixed:
                    k, b = int(rng.integers(8, width - 8)), arrays[other[j]]
                    at = rng.integers(0, len(b) - width + 1) * int(rng.random() < 0.5)  # often from its beginning
                    x[k, j] = 32
                    x[k + 1 :, j], y[k + 1 :, j] = b[at : at + width - k - 1], y_all[other[j]]
            value, grads = self.loss(x, y)
            last.append(value)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g *= min(1.0, 1.0 / (norm + 1e-9))
                m[k] += 0.1 * (g - m[k])
                v2[k] += 0.01 * (g * g - v2[k])
                self.p[k] -= rate * (1 - 0.95 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)
        return float(np.mean(last[-50:]))

    # -- use -----------------------------------------------------------------------------------
    def probabilities(self, texts: list[bytes], batch: int = 1024) -> np.ndarray:
        """Class probabilities [N, classes] of whole texts: each byte is labelled from both sides, and the
        probabilities of a text's bytes are averaged. Empty texts get equal probabilities."""
        c = len(self.classes)
        out = np.full((len(texts), c), 1.0 / c, np.float32)
        order = sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: len(texts[i]))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            n, begin, prob = self._labelled([texts[i] for i in some])
            total = np.zeros((c, len(some)), np.float32)
            for t, a in enumerate(begin):
                total[:, a:] += prob[t, :, a:]
            out[some] = (total / n).T
        return out

    def positions(self, texts: list[bytes], piece: int = 1024, around: int = 128) -> list[np.ndarray]:
        """Class probabilities [bytes, classes] at every byte of texts of any length.

        Long texts are labelled in pieces, each with ``around`` bytes of what stands before and after it."""
        out = [np.empty((len(t), len(self.classes)), np.float32) for t in texts]
        cuts = sorted(((i, a, t[max(0, a - around) : a + piece + around]) for i, t in enumerate(texts) for a in range(0, len(t), piece)), key=lambda c: len(c[2]))
        for k in range(0, len(cuts), 256):
            some = cuts[k : k + 256]
            _, _, prob = self._labelled([c for _, _, c in some])
            for j, (i, a, _) in enumerate(some):
                skip, end = min(a, around), min(len(texts[i]), a + piece)
                out[i][a:end] = prob[skip : skip + end - a, :, j]
        return out

    def _labelled(self, texts: list[bytes]):
        """Lengths, the first text that reaches each step, and class probabilities [T, classes, B] at every byte
        of texts in order of length; what is behind the end of a text is undefined."""
        n = np.array([len(t) for t in texts])
        steps = int(n[-1])
        x = np.zeros((steps, len(texts)), np.uint8)
        for j, t in enumerate(texts):
            x[: len(t), j] = np.frombuffer(t, np.uint8)
        begin = np.searchsorted(n, np.arange(steps), side="right").tolist()
        prob = np.empty((steps, len(self.classes), len(texts)), np.float32)
        self._scores(x, begin, range(steps), "f", prob)
        self._scores(x, begin, range(steps - 1, -1, -1), "b", prob)
        for t, a in enumerate(begin):
            s = prob[t, :, a:]
            s -= s.max(0)
            np.exp(s, out=s)
            s /= s.sum(0)
        return n, begin, prob

    def _scores(self, x, begin, times, d: str, prob) -> None:
        """Scores of one direction into ``prob`` (forward) or added to it (backward), without keeping the states.

        Texts are in order of length, so those that reach a step are the last ones; a text's state stays 0 until its end is
        reached from behind. Gates have arrays of their own, because steps are fastest on whole arrays."""
        h, p = self.hidden, {k: self.p[k + d] for k in ("wx", "u", "b", "wo")}
        half = np.float32(0.5)
        part = lambda a, k: np.ascontiguousarray(a[:, k * h : (k + 1) * h], np.float32)
        wr, wz = (part(p["wx"] + p["b"], k) * half for k in (0, 1))  # a sigmoid is a tanh of half its input
        ur, uz = (part(p["u"], k) * half for k in (0, 1))
        wn, un, bn, wo = part(p["wx"], 2), part(p["u"], 2), p["b"][2 * h :].astype(np.float32), np.ascontiguousarray(p["wo"].T, np.float32)
        size = x.shape[1]
        state, *room = (np.zeros((size, h), np.float32) for _ in range(5))
        for t in times:
            a = begin[t]
            s, (r, z, n, g), byte = state[a:], (m[: size - a] for m in room), x[t, a:]
            for gate, u, w in ((r, ur, wr), (z, uz, wz)):
                np.matmul(s, u, out=gate)
                np.take(w, byte, 0, out=g, mode="clip")
                gate += g
                np.tanh(gate, out=gate)
                gate += 1
                gate *= half
            np.matmul(s, un, out=n)
            n += bn
            n *= r
            np.take(wn, byte, 0, out=g, mode="clip")
            n += g
            np.tanh(n, out=n)
            s -= n
            s *= z
            s += n
            if d == "f":
                np.add(wo @ s.T, self.p["bo"][:, None], out=prob[t, :, a:], casting="same_kind")
            else:
                prob[t, :, a:] += wo @ s.T

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, classes=np.array(self.classes), hidden=self.hidden, **self.p)
        return f.getvalue()

    @classmethod
    def load(cls, data: bytes) -> ByteGRU:
        z = np.load(io.BytesIO(data))
        g = cls([str(c) for c in z["classes"]], int(z["hidden"]))
        g.p = {k: z[k] for k in g.p}
        return g
