"""A small gated recurrent language model in numpy.

Words are numbered: 0 .. n_head-1 are words with embeddings and an output weight of their own, n_head .. n_head+n_tail-1 stand for the
classes of all other words. The output is factored into classes of ``CLASS_SIZE`` numbers: P(class | state) P(number | class, state), so a
token costs two short softmaxes; the tail's numbers are the last class or classes. What a tail word has within its number is not the
model's matter. Documents run side by side in lanes, a lane takes up its next document when one ends, and the state goes on from window to
window, so a document of any length is read whole; gradients are cut at window borders.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

CLASS_SIZE = 64


@dataclass
class Shape:
    """n_head and n_tail are multiples of CLASS_SIZE."""

    n_head: int = 2048
    n_tail: int = 64
    embed: int = 12
    hidden: int = 16

    @property
    def n_words(self) -> int:
        return self.n_head + self.n_tail

    @property
    def n_classes(self) -> int:
        return self.n_words // CLASS_SIZE

    def sizes(self) -> dict[str, tuple[int, ...]]:
        """Biases of the output are the last column or row: states have a one there."""
        h = self.hidden
        return {"emb": (self.n_words, self.embed), "wx": (self.embed, 3 * h), "wh": (h, 3 * h), "b": (3 * h,), "wc": (h + 1, self.n_classes), "ww": (self.n_words, h + 1)}

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, size in self.sizes().items():
            n = int(np.prod(size))
            out[name] = flat[at:at + n].reshape(size)
            at += n
        return out

    def start(self, counts: np.ndarray, seed: int = 1) -> np.ndarray:
        """Small random weights; the biases give the frequencies of the numbers, so an untrained model is the unigram."""
        rng = np.random.default_rng(seed)
        p = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in self.sizes().items()}
        p["wc"] *= 0.1
        p["ww"] *= 0.1
        p["b"][:] = 0
        p["wc"][-1], p["ww"][:, -1] = np.log(counts.reshape(-1, CLASS_SIZE).sum(axis=1) + 1e-3), np.log(counts + 1e-3)
        return np.concatenate([p[k].ravel() for k in self.sizes()]).astype(np.float32)


def lanes_of(lengths: np.ndarray, n_lanes: int) -> list[list[int]]:
    """Documents dealt to lanes, long ones first, each to the lane with the least so far; lanes by falling total length."""
    lanes: list[list[int]] = [[] for _ in range(max(1, min(n_lanes, len(lengths))))]
    heap = [(0, k) for k in range(len(lanes))]
    for d in np.argsort(-lengths, kind="stable").tolist():
        total, k = heapq.heappop(heap)
        lanes[k].append(d)
        heapq.heappush(heap, (total + int(lengths[d]), k))
    return sorted(lanes, key=lambda x: -sum(int(lengths[d]) for d in x))


def windows(ids: np.ndarray, starts: np.ndarray, end_id: int, n_lanes: int, steps: int):
    """(inputs, targets, keep, owner), each steps x lanes; documents end with end_id and follow it; owner is -1 where a lane is over.

    Where only the lanes of very long documents go on, windows have more steps, so that they hold about as many tokens as others.
    """
    lengths = np.diff(starts) + 1
    if not len(lengths):
        return
    lanes = lanes_of(lengths, n_lanes)
    order = np.array([d for lane in lanes for d in lane])
    n = lengths[order]
    ends = np.cumsum(n)
    # All lanes one after the other, and one more place for what lies beyond a lane.
    source = np.repeat(starts[order] - (ends - n), n)
    source += np.arange(ends[-1])
    source[ends - 1] = len(ids)
    targets = np.append(np.append(ids, end_id)[source], end_id).astype(np.int32)
    inputs = np.concatenate(([end_id], targets[:-1])).astype(np.int32)  # before a document stands the end of another
    keep = np.ones(ends[-1] + 1, np.float32)
    keep[ends - n] = 0
    owner = np.append(np.repeat(order, n), -1)
    totals = np.array([int(lengths[lane].sum()) for lane in lanes])
    begin = np.cumsum(totals) - totals
    t0 = 0
    while t0 < totals[0]:
        k = int(np.searchsorted(-totals, -t0, side="left"))  # lanes that are longer than t0
        span = max(steps, n_lanes * steps // (4 * k))
        t = np.arange(t0, t0 + span)[:, None]
        at = np.where(t < totals[:k], begin[:k] + t, len(targets) - 1)
        yield inputs[at], targets[at], keep[at], owner[at]
        t0 += span


def _exps(logits: Callable[[np.ndarray], np.ndarray], weights: np.ndarray, top: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """exp(logits(weights)) of each row up to a factor, and the rows' sums. Logits are shifted by the largest bias (``top``; biases are the last
    column of the weights), which keeps exp in range for all but huge weights; if a sum does leave it, each row is shifted by its own maximum."""
    shifted = weights.copy()
    shifted[:, -1] -= top
    x = logits(shifted)
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], np.float32)
    if len(x) and not (total.min() > 1e-30 and total.max() < 1e30):
        x = logits(weights)
        x -= x.max(axis=1, keepdims=True)
        np.exp(x, out=x)
        total = np.einsum("ij->i", x)
    return x, total


class Model:
    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, self.flat = shape, flat.astype(np.float32)
        self.p = shape.split(self.flat)

    def _run(self, x: np.ndarray, keep: np.ndarray, h: np.ndarray, store: bool):
        """States (with a last column of ones) of all steps, the last state, and with ``store`` what the gradient needs: before, gates with g_n, n.

        Within, lanes are the last axis, so that a gate of all lanes lies in one piece. A sigmoid is (1 + tanh(v / 2)) / 2; the weights are halved
        beforehand.
        """
        hid, p, (steps, lanes) = self.shape.hidden, self.p, x.shape
        table, wh_t = p["emb"] @ p["wx"] + p["b"], np.ascontiguousarray(p["wh"].T)
        table[:, :2 * hid] *= 0.5
        wh_t[:2 * hid] *= 0.5
        a = np.ascontiguousarray(table[x].transpose(0, 2, 1))
        states = np.empty((steps, hid, lanes), np.float32)
        saved = [np.empty((steps if store else 1, n * hid, lanes), np.float32) for n in (1, 3, 1)]
        resets = (keep == 0).any(axis=1)
        h = np.ascontiguousarray(h.T)
        for t in range(steps):
            before, g, n = (v[t if store else 0] for v in saved)
            np.multiply(h, keep[t], out=before) if resets[t] else np.copyto(before, h)
            np.matmul(wh_t, before, out=g)
            gates = g[:2 * hid]
            gates += a[t, :2 * hid]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            np.multiply(gates[hid:], g[2 * hid:], out=n)
            n += a[t, 2 * hid:]
            np.tanh(n, out=n)
            h = states[t]
            np.subtract(before, n, out=h)
            h *= gates[:hid]
            h += n
        out = np.ones((steps, lanes, hid + 1), np.float32)
        out[:, :, :hid] = states.transpose(0, 2, 1)
        return out, out[-1, :, :hid], saved

    def _by_class(self, states: np.ndarray, y: np.ndarray):
        """The order that puts targets of a class together; states and targets in that order, their classes, and where each class that occurs lies."""
        cls = y // CLASS_SIZE
        order = np.argsort(cls.astype(np.int16), kind="stable")
        ends = np.cumsum(np.bincount(cls, minlength=self.shape.n_classes))
        parts = [(slice(c * CLASS_SIZE, (c + 1) * CLASS_SIZE), slice(i, j)) for c, (i, j) in enumerate(zip((0, *ends), ends)) if j > i]
        return order, states[order], y[order], cls[order], parts

    def _exps_of_classes(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wc = np.ascontiguousarray(self.p["wc"].T)
        return _exps(lambda w: states @ w.T, wc, float(wc[:, -1].max()))

    def _exps_in_class(self, states: np.ndarray, parts: list[tuple[slice, slice]]) -> tuple[np.ndarray, np.ndarray]:
        """Those of the numbers of each row's class; rows lie class by class."""

        def logits(w: np.ndarray) -> np.ndarray:
            x = np.empty((len(states), CLASS_SIZE), np.float32)
            for words, at in parts:
                np.matmul(states[at], w[words].T, out=x[at])
            return x

        ww = self.p["ww"]
        return _exps(logits, ww, np.repeat(ww[:, -1].reshape(-1, CLASS_SIZE).max(axis=1), CLASS_SIZE))

    def log10_of(self, states: np.ndarray, y: np.ndarray) -> np.ndarray:
        """log10 P(class) P(number | class) of each target."""
        order, states, y, cls, parts = self._by_class(states, y)
        rows, out = np.arange(len(y)), np.empty(len(y), np.float32)
        found = [np.log(np.maximum(x[rows, at], 1e-37) / total) for (x, total), at in ((self._exps_of_classes(states), cls), (self._exps_in_class(states, parts), y % CLASS_SIZE))]
        out[order] = found[0] + found[1]
        return out / np.log(10)

    def score(self, ids: np.ndarray, starts: np.ndarray, end_id: int, n_lanes: int = 512, steps: int = 32) -> np.ndarray:
        """For each document the sum of log10_of over its words and its end."""
        total = np.zeros(len(starts) - 1)
        h = None
        for x, y, keep, owner in windows(ids, starts, end_id, n_lanes, steps):
            h = np.zeros((x.shape[1], self.shape.hidden), np.float32) if h is None else h[:x.shape[1]]
            out, h, _ = self._run(x, keep, h, False)
            if (over := owner < 0).any():
                real = ~over
                out, y, owner = out[real], y[real], owner[real]
            found = self.log10_of(out.reshape(-1, out.shape[-1]), y.ravel())
            total += np.bincount(owner.ravel(), weights=found, minlength=len(total))
        return total

    def _gradient(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray, real: np.ndarray, h: np.ndarray, grad: dict[str, np.ndarray]) -> np.ndarray:
        p, hid = self.p, self.shape.hidden
        out, h, (before, g, n) = self._run(x, keep, h, True)
        whole = real.all()
        order, states, targets, cls, parts = self._by_class(*((out.reshape(-1, hid + 1), y.ravel()) if whole else (out[real], y[real])))
        # A row's gradient of the logits is (exp - sum at its target) / sum; what is narrow is divided, not the logits.
        rows = np.arange(len(states))
        d, total = self._exps_of_classes(states)
        d[rows, cls] -= total
        share = (1 / total)[:, None]
        grad["wc"] += (states * share).T @ d
        dstates = d @ p["wc"].T
        dstates *= share
        e, total = self._exps_in_class(states, parts)
        e[rows, targets % CLASS_SIZE] -= total
        share = (1 / total)[:, None]
        scaled, more = states * share, np.empty_like(states)
        for words, at in parts:
            grad["ww"][words] += e[at].T @ scaled[at]
            np.matmul(e[at], p["ww"][words], out=more[at])
        more *= share
        dstates += more
        dout = np.zeros((x.size, hid), np.float32)
        dout[order if whole else np.flatnonzero(real.ravel())[order]] = dstates[:, :hid]
        dout = np.ascontiguousarray(dout.reshape(*x.shape, hid).transpose(0, 2, 1))
        z, r, gn = g[:, :hid], g[:, hid:2 * hid], g[:, 2 * hid:]
        # What the gradient of a state is multiplied by for z, r and n, for all steps at once; the products take their place.
        to_n = (1 - z) * (1 - n * n)
        da = np.empty((len(x), 3, hid, x.shape[1]), np.float32)
        np.multiply(to_n, r, out=da[:, 2])
        np.multiply(da[:, 2], gn * (1 - r), out=da[:, 1])
        np.multiply((before - n) * z, 1 - z, out=da[:, 0])
        flat_da = da.reshape(len(x), 3 * hid, x.shape[1])
        carry, kept = np.zeros((hid, x.shape[1]), np.float32), np.empty((hid, x.shape[1]), np.float32)
        resets = (keep == 0).any(axis=1)
        for t in range(len(x) - 1, -1, -1):
            dh = dout[t]
            dh += carry
            da[t] *= dh
            np.matmul(p["wh"], flat_da[t], out=carry)
            np.multiply(dh, z[t], out=kept)
            carry += kept
            if resets[t]:
                carry *= keep[t]
        grad["wh"] += np.matmul(before, flat_da.transpose(0, 2, 1)).sum(axis=0)
        np.multiply(dout, to_n, out=da[:, 2])  # the input's share of n isn't weighted by r
        flat_x, flat_a = x.ravel(), flat_da.transpose(0, 2, 1).reshape(-1, 3 * hid)
        by_id = np.argsort(flat_x.astype(np.int16) if self.shape.n_words < 2**15 else flat_x, kind="stable")
        sorted_x = flat_x[by_id]
        first = np.flatnonzero(np.diff(sorted_x, prepend=-1))
        used, sums = sorted_x[first], np.add.reduceat(flat_a.take(by_id, axis=0), first, axis=0)
        grad["emb"][used] += sums @ p["wx"].T
        grad["wx"] += p["emb"][used].T @ sums
        grad["b"] += sums.sum(axis=0)
        return h

    def train(self, ids: np.ndarray, starts: np.ndarray, end_id: int, n_lanes: int = 256, steps: int = 32, rate: float = 0.02) -> int:
        """One pass of truncated backpropagation (Adam, clipped); returns the number of targets, all of which have moved the weights."""
        grad_flat = np.zeros_like(self.flat)
        grad = self.shape.split(grad_flat)
        m, v, step, seen, held, turn = np.zeros_like(self.flat), np.zeros_like(self.flat), np.empty_like(self.flat), 0, 0, 0
        h = None

        def update() -> None:
            nonlocal step, seen, held, turn
            turn += 1
            g = grad_flat
            g /= held
            g *= min(1.0, 1.0 / max(float(np.sqrt(g @ g)), 1e-12))
            np.subtract(g, m, out=step)
            step *= 0.1
            m[:] += step
            np.multiply(g, g, out=step)
            step -= v
            step *= 0.01
            v[:] += step
            np.multiply(v, 1 / (1 - 0.99**turn), out=step)
            np.sqrt(step, out=step)
            step += 1e-6
            np.divide(m, step, out=step)
            step *= rate / (1 + turn / 400) / (1 - 0.9**turn)
            self.flat -= step
            grad_flat[:] = 0
            seen, held = seen + held, 0

        for x, y, keep, owner in windows(ids, starts, end_id, n_lanes, steps):
            h = np.zeros((x.shape[1], self.shape.hidden), np.float32) if h is None else h[:x.shape[1]]
            real = owner >= 0
            h = self._gradient(x, y, keep, real, h, grad)
            held += int(real.sum())
            if held >= n_lanes * steps // 2:
                update()
        if held:
            update()
        return seen
