"""A small causal self-attention language model in numpy.

One layer with one head: inputs are embedded units; queries, keys, values and a part of their own are linear in them; a
learned bias by distance is added to the products; the attended values and the own part make a hidden layer between -1
and 1. Its softmax has two levels: a group of units, then a unit of the group, so that a score costs the square root of
the number of units. Weights are held within limits, so no logit leaves the range of exp and probabilities sum to 1.

Arrays of a step are made once and used again (Buffers): fresh memory for each would cost more than the arithmetic.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np

MOST_LOGIT = np.float32(60)
MOST_SHIFT = np.float32(20)


@dataclass(frozen=True)
class Shape:
    groups: int = 32
    members: int = 32
    width: int = 16
    hidden: int = 32
    window: int = 24  #: tokens that a window sees
    stride: int = 16  #: tokens that a window scores; the rest is context

    @property
    def units(self) -> int:
        """Units that are predicted. One more number, units, marks the start of a text."""
        return self.groups * self.members

    def parts(self) -> dict[str, tuple[int, ...]]:
        """Of linear, group and member the last row is a shift."""
        d, h = self.width, self.hidden
        return {
            "embed": (self.units + 1, d),
            "linear": (d + 1, 2 * d + 2 * h),  # query, key, value, own
            "distance": (self.window,),
            "group": (h + 1, self.groups),
            "member": (self.groups, h + 1, self.members),
        }

    def cuts(self) -> tuple[slice, slice, slice, slice]:
        """Columns of the linear part: query, key, value, own."""
        d, h = self.width, self.hidden
        return slice(0, d), slice(d, 2 * d), slice(2 * d, 2 * d + h), slice(2 * d + h, 2 * d + 2 * h)


def split(flat: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    """Views of one array of parameters."""
    out, at = {}, 0
    for name, size in shape.parts().items():
        n = math.prod(size)
        out[name] = flat[at : at + n].reshape(size)
        at += n
    return out


def initial(shape: Shape, counts: np.ndarray | None = None, seed: int = 5) -> np.ndarray:
    """First parameters. counts: of each unit, from which the output's shifts start."""
    rng = np.random.default_rng(seed)
    flat = rng.normal(size=sum(int(np.prod(s)) for s in shape.parts().values())).astype(np.float32)
    p = split(flat, shape)
    p["embed"] *= 0.5
    p["linear"] *= shape.width**-0.5
    p["group"] *= 0.1
    p["member"] *= 0.1
    for shift in (p["linear"][-1], p["distance"], p["group"][-1], p["member"][:, -1]):
        shift[...] = 0
    if counts is not None:
        share = (counts.reshape(shape.groups, shape.members) + 0.5) / (counts.sum() + 0.5 * shape.units)
        p["group"][-1] = np.log(share.sum(1))
        p["member"][:, -1] = np.log(share / share.sum(1, keepdims=True))
    limit(flat, shape)
    return flat


@cache
def _most(shape: Shape) -> np.ndarray:
    """The limit of each parameter."""
    flat = np.full(sum(map(math.prod, shape.parts().values())), np.inf, np.float32)
    p = split(flat, shape)
    for part in (p["group"], p["member"]):
        part[..., :-1, :] = (MOST_LOGIT - MOST_SHIFT) / np.float32(shape.hidden)
        part[..., -1, :] = MOST_SHIFT
    return flat


def limit(flat: np.ndarray, shape: Shape) -> None:
    """Hold the output's weights where logits of a hidden layer between -1 and 1 stay below MOST_LOGIT."""
    np.minimum(flat, _most(shape), out=flat)
    np.maximum(flat, -_most(shape), out=flat)


class Buffers:
    """Arrays by name, made when first asked for and used again while they are large enough."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def get(self, name: str, *size: int, kind: type = np.float32) -> np.ndarray:
        n, held = math.prod(size), self.held.get(name)
        if held is None or len(held) < n or held.dtype != kind:
            held = self.held[name] = np.zeros(n, kind)
        return held[:n].reshape(size)


def attend(weights: np.ndarray, factor: np.ndarray) -> None:
    """Turn products into weights that are not normalised yet: e to the product, times the factor of each pair of places."""
    np.clip(weights, -MOST_LOGIT, MOST_LOGIT, out=weights)
    np.exp(weights, out=weights)
    weights *= factor


@cache
def _far(first: int, window: int) -> np.ndarray:
    """How far each place of a window lies before each of its places first..window - 1; below 0 where behind."""
    return np.arange(first, window)[:, None] - np.arange(window)[None, :]


def factors(distance: np.ndarray, first: int, window: int) -> np.ndarray:
    """For places first..window - 1 of a window and all its places: 0 where masked, else e to the distance's bias."""
    far = _far(first, window)
    return np.where(far >= 0, np.exp(np.clip(distance, -MOST_SHIFT, MOST_SHIFT))[far.clip(0)], 0).astype(distance.dtype)


def two_levels(p: dict[str, np.ndarray], shape: Shape, hidden: np.ndarray, target: np.ndarray, buffers: Buffers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(log-probabilities of the targets, their order by group, both levels' exp of logits, and where groups begin).

    hidden ends with a column of ones. Log-probabilities and the second level's rows are in that order; the levels'
    exps are divided by their sums.
    """
    n, kind = len(target), hidden.dtype
    group, member = target // shape.members, target % shape.members
    order = np.argsort(group.astype(np.uint16), kind="stable")
    cuts = np.searchsorted(group, np.arange(shape.groups + 1), sorter=order).tolist()
    group, member = group.take(order), member.take(order)
    sorted_hidden = hidden.take(order, 0, out=buffers.get("sorted", *hidden.shape, kind=kind), mode="clip")
    levels = []
    logs = buffers.get("logs", n, kind=kind)
    logs[:] = 0
    for level, column in (("group", group), ("member", member)):
        e = buffers.get(level, n, p[level].shape[-1], kind=kind)
        if level == "group":
            np.matmul(sorted_hidden, p["group"], out=e)
        else:
            for c in range(shape.groups):
                if cuts[c] < cuts[c + 1]:
                    np.matmul(sorted_hidden[cuts[c] : cuts[c + 1]], p["member"][c], out=e[cuts[c] : cuts[c + 1]])
        logs += e.reshape(-1).take(np.arange(n) * e.shape[1] + column)
        np.exp(e, out=e)
        sums = e @ np.ones(e.shape[1], kind)
        logs -= np.log(sums)
        levels.append((e, sums, column))
    return logs, order, sorted_hidden, levels, cuts


class Scorer:
    """Scores texts of units with fixed parameters; what is linear in an embedding is a table by unit."""

    def __init__(self, flat: np.ndarray, shape: Shape) -> None:
        self.s, self.p, self.buffers = shape, split(flat, shape), Buffers()
        q, k, v, own = shape.cuts()
        e = (self.p["embed"] @ self.p["linear"][:-1] + self.p["linear"][-1]).astype(np.float32)
        self.query = np.ascontiguousarray(e[:, q]) * np.float32(shape.width**-0.5)
        self.key = np.ascontiguousarray(e[:, k].T)
        self.value = np.ascontiguousarray(e[:, v])
        self.own = np.ascontiguousarray(e[:, own])
        self.factor = factors(self.p["distance"], shape.window - shape.stride, shape.window)

    def score(self, units: np.ndarray, places: np.ndarray, batch: int = 256, held: int = 1024) -> np.ndarray:
        """Natural logarithm of each token's probability. units of text i stand at places[i]:places[i + 1].

        Each window scores its last `stride` tokens, so each token is scored once. A text's first window begins where it
        begins, so its scores do not depend on the other texts; positions before a text's start and after the scored one
        are masked. batch windows are attended to at once; the outputs of held windows are made at once.
        """
        w, s, h = self.s.window, self.s.stride, self.s.hidden
        lengths = np.diff(places)
        count = -(-lengths // s)
        begin = np.cumsum(count) - count  # the first window of each text
        total = int(count.sum())
        place = np.arange(len(units)) + np.repeat(begin * s - places[:-1], lengths)
        inputs = np.full(total * s + w - s, self.s.units, np.int32)
        inputs[place[1:] + w - s] = units[:-1]
        inputs[begin[lengths > 0] * s + w - s] = self.s.units
        number = np.arange(total) - np.repeat(begin, count)  # of a window in its text
        early = [np.flatnonzero(number == i) for i in range(-(-(w - s) // s))]
        out = np.empty(len(units), np.float32)
        for low in range(0, total, held):
            high = min(low + held, total)
            a, b = np.searchsorted(place, (low * s, high * s))
            hidden = self.buffers.get("hidden", (high - low) * s, h + 1)
            hidden[:, -1] = 1
            for first in range(low, high, batch):
                last = min(first + batch, high)
                self._hidden(inputs[first * s : last * s + w - s], last - first, [e[np.searchsorted(e, first) : np.searchsorted(e, last)] - first for e in early], hidden[(first - low) * s : (last - low) * s, :-1])
            real = hidden.take(place[a:b] - low * s, 0, out=self.buffers.get("real", b - a, h + 1), mode="clip")
            logs, order, *_ = two_levels(self.p, self.s, real, units[a:b], self.buffers)
            out[a + order] = logs
        return out

    def _hidden(self, inputs: np.ndarray, n: int, early: list[np.ndarray], out: np.ndarray) -> None:
        """The hidden layer of n neighbouring windows. early[i]: those that are number i of their text."""
        w, s, d, h = self.s.window, self.s.stride, self.s.width, self.s.hidden
        get, view = self.buffers.get, np.lib.stride_tricks.as_strided
        mine = inputs[w - s :]
        query = self.query.take(mine, 0, out=get("query", n * s, d), mode="clip").reshape(n, s, d)
        key = self.key.take(inputs, 1, out=get("key", d, len(inputs)), mode="clip")
        value = self.value.take(inputs, 0, out=get("value", len(inputs), h), mode="clip")
        weights = np.matmul(query, view(key, (n, d, w), (s * 4, key.strides[0], 4), writeable=False), out=get("weights", n, s, w))
        attend(weights, self.factor)
        for i, at in enumerate(early):
            weights[at, :, : w - s - i * s] = 0
        sums = weights.reshape(n * s, w) @ np.ones(w, np.float32)
        seen = np.matmul(weights, view(value, (n, w, h), (s * value.strides[0], *value.strides), writeable=False), out=get("seen", n, s, h)).reshape(n * s, h)
        seen *= (1 / np.maximum(sums, np.float32(1e-30)))[:, None]
        seen += self.own.take(mine, 0, out=get("own", n * s, h), mode="clip")
        np.tanh(seen, out=out)


def gradient(flat: np.ndarray, shape: Shape, inputs: np.ndarray, targets: np.ndarray, buffers: Buffers | None = None) -> tuple[float, np.ndarray]:
    """Mean loss of windows (rows of inputs and targets; targets below 0 do not count) and its gradient."""
    buffers, kind = buffers or Buffers(), flat.dtype
    get = lambda name, *size: buffers.get(name, *size, kind=kind)
    p, d = split(flat, shape), get("gradient", len(flat))
    d[:] = 0
    g = split(d, shape)
    (n, w), h, width = inputs.shape, shape.hidden, shape.width
    ids, columns = inputs.reshape(-1), shape.cuts()
    scale = kind.type(width**-0.5)
    # one product for all four parts and their shifts; queries are scaled on the way
    linear = p["linear"].copy()
    linear[:, columns[0]] *= scale
    table = np.append(p["embed"], np.ones((len(p["embed"]), 1), kind), 1)
    x = table.take(ids, 0, out=get("x", n * w, width + 1), mode="clip")
    wide = np.matmul(x, linear, out=get("wide", n * w, linear.shape[1])).reshape(n, w, -1)
    q, k, v, own = (wide[..., c] for c in columns)
    a = np.matmul(q, k.transpose(0, 2, 1), out=get("weights", n, w, w))
    attend(a, factors(p["distance"], 0, w))
    a *= (1 / (a @ np.ones(w, kind)))[..., None]
    seen = np.matmul(a, v, out=get("seen", n, w, h))
    top = np.add(own, seen, out=get("top", n, w, h)).reshape(n * w, h)
    np.tanh(top, out=top)
    real = np.flatnonzero(targets.reshape(-1) >= 0)
    hidden = get("hidden", len(real), h + 1)
    hidden[:, :-1] = top if len(real) == n * w else top.take(real, 0)
    hidden[:, -1] = 1
    total = max(1, len(real))
    logs, order, hidden, levels, cuts = two_levels(p, shape, hidden, targets.reshape(-1)[real], buffers)
    for e, sums, column in levels:
        e *= (1 / sums)[:, None]
        e.reshape(-1)[np.arange(len(real)) * e.shape[1] + column] -= 1
    dg, dm = levels[0][0], levels[1][0]
    np.matmul(hidden.T, dg, out=g["group"])
    back = np.matmul(dg, p["group"][:-1].T, out=get("back", len(real), h))
    more = get("more", len(real), h)
    for c in range(shape.groups):
        low, high = cuts[c], cuts[c + 1]
        if low < high:
            np.matmul(hidden[low:high].T, dm[low:high], out=g["member"][c])
            np.matmul(dm[low:high], p["member"][c, :-1].T, out=more[low:high])
    back += more
    dh = get("dh", n * w, h)
    if len(real) < n * w:
        dh[:] = 0
    dh[real.take(order)] = back
    np.multiply(top, top, out=top)
    np.subtract(1, top, out=top)
    back_wide = get("back wide", n, w, linear.shape[1])
    dq, dk, dv, down = (back_wide[..., c] for c in columns)
    dh *= top
    dh = dh.reshape(n, w, h)
    down[:] = dh
    np.matmul(a.transpose(0, 2, 1), dh, out=dv)
    ds = np.matmul(dh, v.transpose(0, 2, 1), out=get("ds", n, w, w))
    seen *= dh
    ds -= (seen.reshape(n * w, h) @ np.ones(h, kind)).reshape(n, w, 1)
    ds *= a
    g["distance"][:] = np.bincount(_far(0, w).clip(0).reshape(-1), ds.reshape(n, w * w).sum(0), shape.window)
    np.matmul(ds, k, out=dq)
    np.matmul(ds.transpose(0, 2, 1), q, out=dk)
    back_wide = back_wide.reshape(n * w, -1)
    np.matmul(x.T, back_wide, out=g["linear"])
    g["linear"][:, columns[0]] *= scale
    dx = np.matmul(back_wide, linear[:-1].T, out=get("dx", n * w, width))
    order = np.argsort(ids.astype(np.uint16) if shape.units < 1 << 16 else ids, kind="stable")
    ids = ids.take(order)
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    g["embed"][ids[first]] = np.add.reduceat(dx.take(order, 0, out=get("sorted dx", n * w, width), mode="clip"), first)
    d /= total
    return -float(logs.sum()) / total, d


def descend(flat: np.ndarray, shape: Shape, inputs: np.ndarray, targets: np.ndarray, batch: int, steps: int, rates: tuple[float, float], seed: int) -> np.ndarray:
    """Adam over shuffled batches of windows; the rate goes from the first of rates to the second."""
    flat, rng, buffers = flat.astype(np.float32).copy(), np.random.default_rng(seed), Buffers()
    m, v, now = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
    order, at = rng.permutation(len(inputs)), 0
    for step in range(1, steps + 1):
        if at >= len(order):
            order, at = rng.permutation(len(inputs)), 0
        rows = order[at : at + batch]
        at += batch
        _, g = gradient(flat, shape, inputs.take(rows, 0), targets.take(rows, 0), buffers)
        m *= np.float32(0.9)
        m += np.multiply(g, np.float32(0.1), out=now)
        v *= np.float32(0.99)
        g *= g
        v += np.multiply(g, np.float32(0.01), out=now)
        np.sqrt(v, out=now)
        now += np.float32(1e-8)
        np.divide(m, now, out=now)
        now *= np.float32((rates[0] + (rates[1] - rates[0]) * step / steps) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step))
        flat -= now
        limit(flat, shape)
    return flat
