"""A small causal self-attention model over subword ids, trained and applied with numpy.

The next id has probability ``p(class | context) * p(id | class, previous id)``. Class logits are the sum of a
table row of the previous id and one head of causal self-attention over the window. The classes come from
clustering ids by their neighbours; the second factor and the table come from counts. The head starts from a
sample, then every task makes a pass over all windows of its texts, and the mean of all steps of all tasks counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Window and how far it moves: a position is scored once, with at least WINDOW - STRIDE ids before it.
WINDOW, STRIDE = 16, 12
WIDTH, CLASSES, INPUTS = 16, 32, 2048
#: Input rows: the most frequent ids, all others, the start.
ROWS = INPUTS + 2
#: Weight of p(id | class) against the counts after one previous id.
PRIOR = 30.0
START, END = 49406, 49407
#: Windows of a training step of the start and of the pass over all texts, and the rate of a step of that pass.
START_WINDOWS, PASS_WINDOWS, PASS_RATE = 192, 512, 0.01
_NEG = np.float32(-1e9)
#: Exponents up to this need no shift: sums of their powers stay within single precision.
_REACH = np.float32(60.0)
_MASK = np.triu(np.full((WINDOW, WINDOW), _NEG, np.float32), 1)
_SCALE = np.float32(WIDTH**-0.5)
_ONES = np.ones(CLASSES, np.float32)
#: Trained weights: embeddings of input rows and places, query, key and value maps, output map.
SHAPES = {"e": (ROWS, WIDTH), "p": (WINDOW, WIDTH), "wq": (WIDTH, WIDTH), "wk": (WIDTH, WIDTH), "wv": (WIDTH, WIDTH), "o": (WIDTH, CLASSES)}


@dataclass(frozen=True)
class Model:
    place: np.ndarray  # id -> input row
    cls: np.ndarray  # id -> class
    within: np.ndarray  # id -> log p(id | class) for ids without an input row of their own, else 0
    pair: np.ndarray  # input rows of the previous id and the id -> log p(id | class, previous id)
    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    pq: np.ndarray
    pk: np.ndarray
    pv: np.ndarray
    out: np.ndarray
    table: np.ndarray
    weights: dict[str, np.ndarray]  # by the names of SHAPES; q to out follow from them


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, token count and first scored position of every window over texts ``bounds[i]:bounds[i + 1]``."""
    length = np.diff(bounds)
    n = 1 + np.maximum(0, -(-(length - WINDOW) // STRIDE))
    n[length == 0] = 0
    text = np.repeat(np.arange(len(length)), n)
    number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = bounds[text] + number * STRIDE
    return first, np.minimum(WINDOW, bounds[text + 1] - first), np.where(number > 0, WINDOW - STRIDE, 0)


def _previous(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[bounds[:-1][np.diff(bounds) > 0]] = START
    return before


def log_probabilities(m: Model, ids: np.ndarray, bounds: np.ndarray, batch: int = 512) -> np.ndarray:
    """Natural log probability of every id given those before it in its text, each scored in one window."""
    rows, classes = m.place[_previous(ids, bounds)], m.cls[ids]
    first, size, scored = windows(bounds)
    score = m.within[ids] + m.pair[rows, m.place[ids]].astype(np.float64)
    at = np.arange(WINDOW)
    for i in range(0, len(first), batch):
        f, s, c = first[i : i + batch], size[i : i + batch], scored[i : i + batch]
        where = np.minimum(f[:, None] + at, len(ids) - 1)
        row = rows[where]
        weight = (m.q[row] + m.pq) @ (m.k[row] + m.pk).transpose(0, 2, 1)
        weight += _MASK
        np.exp(weight, out=weight)
        mixed = weight @ (m.v[row] + m.pv)
        # Row sums as products: a reduction over a short last axis takes far longer.
        mixed /= (weight.reshape(-1, WINDOW) @ _ONES[:WINDOW]).reshape(*row.shape, 1)
        take = (at >= c[:, None]) & (at < s[:, None])
        place = where[take]
        logits = mixed[take] @ m.out
        logits += m.table.take(rows[place], axis=0)
        own = logits[np.arange(len(place)), classes[place]]
        np.exp(logits, out=logits)
        score[place] += own - np.log(logits @ _ONES)
    return score


def places(counts: np.ndarray) -> np.ndarray:
    """Input row of every id: one for each of the most frequent, one for all others, one for the start."""
    place = np.full(len(counts), INPUTS, np.int32)
    place[np.argsort(-counts, kind="stable")[:INPUTS]] = np.arange(INPUTS)
    place[START] = INPUTS + 1
    return place


def neighbours(place: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``previous row * ROWS + row`` of every id."""
    return place[_previous(ids, bounds)].astype(np.int64) * ROWS + place[ids]


def cluster(counts: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Class of every id: the most frequent ids grouped by the input rows next to them, from the counts of neighbouring rows."""
    top = np.argsort(-counts, kind="stable")[:INPUTS]
    root = np.sqrt(after).astype(np.float32)
    points = np.concatenate([root.T, root], axis=1)[:INPUTS]
    points /= np.linalg.norm(points, axis=1, keepdims=True) + 1e-6
    weight = np.sqrt(counts[top]) + 1e-3
    centres = points[: CLASSES - 1].copy()
    for _ in range(12):
        own = np.argmax(points @ centres.T, axis=1)
        for c in range(CLASSES - 1):
            mine = own == c
            if mine.any():
                centres[c] = (points[mine] * weight[mine, None]).sum(0)
        centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-6
    cls = np.full(len(counts), CLASSES - 1, np.int32)
    cls[top] = own
    return cls


def _beyond(x: np.ndarray) -> bool:
    """Whether exponents of these must be shifted by the greatest of their row."""
    return not (x.max(initial=0) <= _REACH and x.min(initial=0) >= -_REACH)


def _gradient(p: dict[str, np.ndarray], table: np.ndarray, row: np.ndarray, classes: np.ndarray, live: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean loss of the classes at the ``live`` places of windows (``row``: their input rows)."""
    shape, flat, share = (*row.shape, WIDTH), row.ravel(), live.ravel() / live.sum()
    x = p["e"].take(flat, axis=0)
    x.reshape(shape)[...] += p["p"]
    q, k, v = ((x @ m).reshape(shape) for m in (p["wq"] * _SCALE, p["wk"], p["wv"]))
    a = q @ k.transpose(0, 2, 1)
    far = _beyond(a)
    a += _MASK
    if far:
        a -= a.max(2, keepdims=True)
    np.exp(a, out=a)
    a /= (a.reshape(-1, WINDOW) @ _ONES[:WINDOW]).reshape(*row.shape, 1)
    h = a @ v
    z, own = table.take(flat, axis=0), h.reshape(-1, WIDTH) @ p["o"]
    far = _beyond(own)
    z += own
    # A row of the table has 0 as its greatest value.
    if far:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z *= (share / (z @ _ONES))[:, None]
    z[np.arange(len(z)), classes.ravel()] -= share
    gh = (z @ p["o"].T).reshape(shape)
    ga = gh @ v.transpose(0, 2, 1)
    ga -= np.einsum("ijk,ijk->ij", gh, h)[:, :, None]
    ga *= a
    gq, gk, gv = ((b @ c).reshape(-1, WIDTH) for b, c in ((ga, k), (ga.transpose(0, 2, 1), q), (a.transpose(0, 2, 1), gh)))
    gq *= _SCALE
    gx = gq @ p["wq"].T
    gx += gk @ p["wk"].T
    gx += gv @ p["wv"].T
    order = np.argsort(flat.astype(np.uint16), kind="stable")
    sorted_rows = flat[order]
    cut = np.flatnonzero(np.concatenate(([True], sorted_rows[1:] != sorted_rows[:-1])))
    e = np.zeros_like(p["e"])
    e[sorted_rows[cut]] = np.add.reduceat(gx[order], cut, axis=0)
    return {"e": e, "p": gx.reshape(shape).sum(0), "wq": x.T @ gq, "wk": x.T @ gk, "wv": x.T @ gv, "o": h.reshape(-1, WIDTH).T @ z}


class _Adam:
    """Changes weights in place, step by step."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.step = p, 0
        self.m1, self.m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def move(self, grad: dict[str, np.ndarray], rate: float) -> None:
        self.step += 1
        pace = np.float32(rate * min(1.0, self.step / 20) / (1 - 0.9**self.step))
        for key, value in self.p.items():
            self.m1[key] += np.float32(0.1) * (grad[key] - self.m1[key])
            self.m2[key] += np.float32(0.01) * (grad[key] ** 2 - self.m2[key])
            value -= pace * self.m1[key] / (np.sqrt(self.m2[key] / np.float32(1 - 0.99**self.step)) + np.float32(1e-7))


def assembled(place: np.ndarray, cls: np.ndarray, within: np.ndarray, pair: np.ndarray, table: np.ndarray, p: dict[str, np.ndarray]) -> Model:
    """Model with the weights ``p``: the maps are multiplied out for every input row and place."""
    q, k, v = p["e"] @ p["wq"] * _SCALE, p["e"] @ p["wk"], p["e"] @ p["wv"]
    pq, pk, pv = p["p"] @ p["wq"] * _SCALE, p["p"] @ p["wk"], p["p"] @ p["wv"]
    # Exponents stay within single precision: a product of the greatest norms bounds every weight.
    reach = (np.linalg.norm(q, axis=1).max() + np.linalg.norm(pq, axis=1).max()) * (np.linalg.norm(k, axis=1).max() + np.linalg.norm(pk, axis=1).max())
    shrink = np.float32(min(1.0, 60.0 / max(reach, 1e-6)))
    q, pq = q * shrink, pq * shrink
    return Model(place, cls, within, pair, *(np.ascontiguousarray(x, np.float32) for x in (q, k, v, pq, pk, pv, p["o"], table)), p)


def train(counts: np.ndarray, pairs: np.ndarray, ids: np.ndarray, bounds: np.ndarray, steps: int = 400, seed: int = 6) -> Model:
    """``counts`` of ids and ``pairs`` (previous input row, input row, count) come from the whole corpus; the head starts from the texts given."""
    rng = np.random.default_rng(seed)
    place = places(counts)
    after = np.zeros((ROWS, ROWS))
    after[pairs[:, 0], pairs[:, 1]] = pairs[:, 2]
    cls = cluster(counts, after)
    soft = counts + 0.05
    mass = np.bincount(cls, soft, CLASSES)
    within = np.log(soft / mass[cls])
    before = _previous(ids, bounds)
    own = np.full(ROWS, CLASSES - 1)
    own[place] = cls
    member = np.zeros((ROWS, CLASSES))
    member[np.arange(ROWS), own] = 1.0
    by_class = after @ member
    alone = np.zeros(ROWS)
    alone[place] = np.exp(within)
    pair = np.log((after + PRIOR * alone) / (by_class[:, own] + PRIOR))
    pair[:, INPUTS:] = 0.0
    within[place < INPUTS] = 0.0
    prior = (np.bincount(cls, counts, CLASSES) + 1) / (counts.sum() + CLASSES)
    table = np.log((by_class + 20 * prior) / (by_class.sum(1, keepdims=True) + 20))
    table = (table - table.max(1, keepdims=True)).astype(np.float32)
    p = {k: rng.standard_normal(s).astype(np.float32) * np.float32(0.0 if k == "o" else 0.3) for k, s in SHAPES.items()}
    first, length, scored = windows(bounds)
    full = np.flatnonzero(length >= 2)
    rows, classes, at, adam = place[before], cls[ids], np.arange(WINDOW), _Adam(p)
    for step in range(1, steps + 1 if len(full) else 1):
        w = rng.choice(full, START_WINDOWS)
        where = np.minimum(first[w][:, None] + at, len(ids) - 1)
        live = ((at < length[w][:, None]) & (at >= scored[w][:, None])).astype(np.float32)
        adam.move(_gradient(p, table, rows[where], classes[where], live), 0.02 * (1 - 0.9 * step / steps))
    return assembled(place, cls, within.astype(np.float32), pair.astype(np.float16), table, p)


def passed(m: Model, texts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, int]:
    """One pass from the weights of ``m`` over all windows of runs of texts (ids, bounds); each id is predicted once.

    The flat sum of the weights after every step, each taken as often as the step had windows, and that number.
    """
    p = {k: v.copy() for k, v in m.weights.items()}
    total, n, at, adam, rng = {k: np.zeros(v.shape) for k, v in p.items()}, 0, np.arange(WINDOW), _Adam(p), np.random.default_rng(7)
    for ids, bounds in texts:
        rows, classes = m.place[_previous(ids, bounds)], m.cls[ids]
        each = -(-np.diff(bounds) // WINDOW)
        number = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        first = np.repeat(bounds[:-1], each) + number * WINDOW
        end = np.minimum(first + WINDOW, np.repeat(bounds[1:], each))
        order = rng.permutation(len(first))
        for i in range(0, len(first), PASS_WINDOWS):
            w = order[i : i + PASS_WINDOWS]
            where = first[w][:, None] + at
            live = (where < end[w][:, None]).astype(np.float32)
            np.minimum(where, len(ids) - 1, out=where)
            adam.move(_gradient(p, m.table, rows[where], classes[where], live), PASS_RATE)
            for key, value in p.items():
                total[key] += value * np.float32(len(w))
            n += len(w)
    return np.concatenate([total[k].ravel() for k in SHAPES]), n


def learnt(m: Model, total: np.ndarray, n: int) -> Model:
    """``m`` with the mean weights of passes: the sum of their flat sums, over that of their numbers of windows."""
    sizes = np.cumsum([0, *(int(np.prod(s)) for s in SHAPES.values())])
    p = {k: (total[a:b] / n).astype(np.float32).reshape(s) for (k, s), a, b in zip(SHAPES.items(), sizes, sizes[1:])}
    return assembled(m.place, m.cls, m.within, m.pair, m.table, p)
