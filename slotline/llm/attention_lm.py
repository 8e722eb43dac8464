"""A small causal self-attention language model on subword ids, with numpy.

One head attends over windows of ``SPAN`` inputs, of which the last ``STRIDE`` are scored; the next window begins
``STRIDE`` later, so every token is scored exactly once and sees ``SPAN - STRIDE`` inputs before its window's part.
Outputs are factored twice. The ``HEAD`` most frequent ids and the end are classes of their own, every other id belongs
to a class by how its text begins, and has its corpus share within that class. Classes, in the order of their texts,
stand in ``GROUPS`` groups of ``MEMBERS``: the model gives a group, then a member of it. So probabilities sum to one
over the vocabulary, and a token costs GROUPS + MEMBERS exponentials.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPAN, STRIDE = 32, 16
GROUPS, MEMBERS, TAILS = 32, 32, 64
HEAD, INPUTS = GROUPS * MEMBERS - TAILS - 1, 2048
WIDTH, HIDDEN = 16, 32
TILE = 16  #: rows of one group of classes that are multiplied together in training
SOME = 16_384  #: weights moved at once
BATCH = 192  #: windows scored at once, few enough for their numbers to stay in a core's cache


@dataclass
class Coding:
    """From ids to input rows, output classes, and log10 shares within a class. The last id is the end of a text."""

    inputs: np.ndarray
    classes: np.ndarray
    within: np.ndarray

    @property
    def end(self) -> int:
        return len(self.classes) - 1

    @classmethod
    def from_counts(cls, counts: np.ndarray, texts: list[bytes]) -> Coding:
        """``counts``: of each id, the end's last. ``texts``: of each id but the end."""
        size = len(counts)
        order = np.argsort(-counts[:-1], kind="stable")
        begins = np.array([(32 if t[:1] == b" " else 0) + (t.lstrip(b" ")[:1] or b"\0")[0] % 32 for t in texts]) % TAILS
        own = order[:HEAD]
        # what a class's text begins with decides its place; the end has none and is first
        named = sorted(
            [(b"", 0, size - 1)]
            + [(texts[i], 1, int(i)) for i in own]
            + [((b" " if t >= 32 else b"") + bytes([64 + t % 32 + (32 if t % 32 else 0)]), 2, t) for t in range(TAILS)]
        )
        classes, tails = np.zeros(size, dtype=np.int32), np.zeros(TAILS, dtype=np.int32)
        for place, (_, kind, x) in enumerate(named):
            (tails if kind == 2 else classes)[x] = place
        rest = np.ones(size, dtype=bool)
        rest[own], rest[-1] = False, False
        classes[rest] = tails[begins[rest[:-1]]]
        inputs = np.full(size, INPUTS, dtype=np.int32)
        inputs[: size - 1] = INPUTS + 1 + begins
        inputs[order[:INPUTS]] = np.arange(min(INPUTS, size - 1))
        weight = counts + 0.5
        total = np.bincount(classes, weights=weight, minlength=GROUPS * MEMBERS)
        return cls(inputs, classes, np.log10(weight / total[classes]))


def windows(lengths: np.ndarray) -> np.ndarray:
    """(first scored position, end of the text) of every window of texts laid end to end."""
    n = -(-lengths // STRIDE)
    start = np.repeat(np.cumsum(lengths) - lengths, n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.stack([start + k * STRIDE, start, start + np.repeat(lengths, n)], axis=1)


def gather(ids: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs [n, SPAN] with their validity, and the positions [n, STRIDE] scored with theirs. ``ids``: input rows."""
    at, start, end = spans[:, :1], spans[:, 1:2], spans[:, 2:3]
    seen = at - (SPAN - STRIDE) + np.arange(SPAN)
    valid = (seen >= start) & (seen < end)
    scored = at + np.arange(STRIDE)
    live = scored < end
    return ids[np.where(valid, seen, 0)], valid, np.where(live, scored, 0), live


class Model:
    SHAPES = {
        "embed": (INPUTS + 1 + TAILS, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH),
        "near": (SPAN,), "mix": (2 * WIDTH, HIDDEN), "mix0": (HIDDEN,), "group": (HIDDEN, GROUPS), "group0": (GROUPS,),
        "member": (GROUPS, HIDDEN, MEMBERS), "member0": (GROUPS, MEMBERS),
    }

    def __init__(self, flat: np.ndarray):
        self.flat, at = np.ascontiguousarray(flat, dtype=np.float32), 0
        self.slope: Model | None = None  # where ``gradient`` keeps its numbers from call to call
        self.p: dict[str, np.ndarray] = {}
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            self.p[name] = self.flat[at : at + size].reshape(shape)
            at += size

    @classmethod
    def start(cls, class_share: np.ndarray, seed: int = 3) -> Model:
        rng = np.random.default_rng(seed)
        model = cls(np.zeros(sum(int(np.prod(x)) for x in cls.SHAPES.values())))
        for name in ("embed", "query", "key", "value", "mix"):
            shape = cls.SHAPES[name]
            model.p[name][:] = rng.normal(size=shape) * (0.3 if name == "embed" else shape[0] ** -0.5)
        for name in ("group", "member"):
            model.p[name][:] = rng.normal(size=cls.SHAPES[name]) * 0.1 * HIDDEN**-0.5
        by = class_share.reshape(GROUPS, MEMBERS)
        model.p["group0"][:] = np.log(by.sum(axis=1))
        model.p["member0"][:] = np.log(by / by.sum(axis=1, keepdims=True))
        return model

    #: how far back each key lies from each query; negative: after it
    BACK = (SPAN - STRIDE + np.arange(STRIDE))[:, None] - np.arange(SPAN)[None, :]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What each input row brings to a window: query, key, value as it is mixed in, and its own part of the mix. Positions
        enter through ``near`` alone, so these depend on the row only."""
        p = self.p
        e = p["embed"]
        return (e @ p["query"]) * np.float32(WIDTH**-0.5), e @ p["key"], e @ (p["value"] @ p["mix"][WIDTH:]), e @ p["mix"][:WIDTH] + p["mix0"]

    def scored(self, tables, x: np.ndarray, valid: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probabilities [n, STRIDE] of the target classes, from ``tables``: gathers in place of projections."""
        q, k, v, own = tables
        at = x[:, SPAN - STRIDE :]
        a = self.shares(q.take(at, axis=0), k.take(x, axis=0), valid)
        h = a @ v.take(x, axis=0)
        h += own.take(at, axis=0)
        np.maximum(h, 0, out=h)
        return self.outputs(h.reshape(-1, HIDDEN), target.ravel()).reshape(target.shape)

    def shares(self, q: np.ndarray, k: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """What each scored place takes from each input. ``q`` is scaled already."""
        a = q @ k.transpose(0, 2, 1)
        a += np.where(self.BACK >= 0, self.p["near"][np.maximum(self.BACK, 0)], np.float32(-1e9))
        if not valid.all():
            a += np.where(valid, np.float32(0), np.float32(-1e9))[:, None, :]
        np.clip(a, -60, 60, out=a)  # far from what weights reach, so that no maximum need be taken off
        np.exp(a, out=a)
        a /= (a @ np.ones(SPAN, dtype=np.float32))[:, :, None]
        return a

    def outputs(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log probabilities of the targets."""
        p = self.p
        group, member = target // MEMBERS, target % MEMBERS
        rows = np.arange(len(h)) * MEMBERS
        ones = np.ones(MEMBERS, dtype=np.float32)
        first = h @ p["group"]
        first += p["group0"]
        np.minimum(first, 60, out=first)
        hit = first.ravel().take(rows + group)
        np.exp(first, out=first)
        log = hit - np.log(first @ ones[:GROUPS])
        order = np.argsort(group.astype(np.int8), kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=GROUPS))]).tolist()
        dealt = h.take(order, axis=0)
        second = np.empty((len(h), MEMBERS), dtype=np.float32)
        for g, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if a < b:
                part = second[a:b]
                np.matmul(dealt[a:b], p["member"][g], out=part)
                part += p["member0"][g]
        np.minimum(second, 60, out=second)
        hit = second.ravel().take(rows + member.take(order))
        np.exp(second, out=second)
        log[order] += hit - np.log(second @ ones)
        return log

    def gradient(self, x: np.ndarray, valid: np.ndarray, target: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, float]:
        """The slope of the mean loss by each weight, and that loss. The slope is overwritten by the next call."""
        p = self.p
        if self.slope is None:
            self.slope = Model(np.zeros_like(self.flat))
        g, scale = self.slope.p, np.float32(WIDTH**-0.5)
        wide = lambda m: m.reshape(-1, WIDTH)
        e = p["embed"].take(x, axis=0)
        eq = wide(np.ascontiguousarray(e[:, SPAN - STRIDE :]))
        q = (eq @ (p["query"] * scale)).reshape(-1, STRIDE, WIDTH)
        k, v = (wide(e) @ p["key"]).reshape(e.shape), (wide(e) @ p["value"]).reshape(e.shape)
        a = self.shares(q, k, valid)
        context = wide(a @ v)
        h = eq @ p["mix"][:WIDTH]
        h += context @ p["mix"][WIDTH:]
        h += p["mix0"]
        np.maximum(h, 0, out=h)

        flat, weight = target.ravel(), (live.ravel() / max(1, int(live.sum()))).astype(np.float32)
        group, member = flat // MEMBERS, flat % MEMBERS
        ones = np.ones(max(len(h), SPAN, GROUPS, MEMBERS), dtype=np.float32)
        first = h @ p["group"]
        first += p["group0"]
        np.minimum(first, 60, out=first)
        hits = np.arange(len(h)) * GROUPS + group
        log = first.ravel().take(hits)
        np.exp(first, out=first)
        total = first @ ones[:GROUPS]
        log -= np.log(total)
        first *= (weight / total)[:, None]
        first.ravel()[hits] -= weight
        # members: tiles of TILE rows of one group each, so that one call multiplies them all; rows that fill up weigh nothing
        place, of = tiles(group)
        dealt = np.zeros((len(of) * TILE, HIDDEN), dtype=np.float32)
        dealt[place] = h
        dealt = dealt.reshape(-1, TILE, HIDDEN)
        members = p["member"].take(of, axis=0)
        second = dealt @ members
        second += p["member0"].take(of, axis=0)[:, None, :]
        np.minimum(second, 60, out=second)
        hits = place * MEMBERS + member
        log += second.ravel().take(hits)
        np.exp(second, out=second)
        total = second.reshape(-1, MEMBERS) @ ones[:MEMBERS]
        log -= np.log(total.take(place))
        shift = np.zeros_like(total)
        shift[place] = weight
        second *= (shift / total).reshape(-1, TILE, 1)
        second.ravel()[hits] -= weight
        loss = -float(log @ weight)

        np.matmul(h.T, first, out=g["group"])
        np.matmul(ones[: len(h)], first, out=g["group0"])
        own = (of == np.arange(GROUPS)[:, None]).astype(np.float32)  # a group's tiles
        np.matmul(own, (dealt.transpose(0, 2, 1) @ second).reshape(len(of), -1), out=g["member"].reshape(GROUPS, -1))
        np.matmul(own, ones[:TILE] @ second, out=g["member0"])
        dh = first @ p["group"].T
        dh += (second @ members.transpose(0, 2, 1)).reshape(-1, HIDDEN).take(place, axis=0)
        dh *= h > 0
        np.matmul(eq.T, dh, out=g["mix"][:WIDTH])
        np.matmul(context.T, dh, out=g["mix"][WIDTH:])
        np.matmul(ones[: len(h)], dh, out=g["mix0"])
        # whole matrices, contiguous, wherever numpy would else multiply one small one at a time
        dc = (dh @ p["mix"][WIDTH:].T).reshape(q.shape)
        dv = wide(a.transpose(0, 2, 1) @ dc)
        ds = dc @ v.transpose(0, 2, 1)
        ds -= ((ds * a) @ ones[:SPAN])[:, :, None]
        ds *= a
        per = np.where(self.BACK >= 0, (ones[: len(x)] @ ds.reshape(len(x), -1)).reshape(self.BACK.shape), 0)
        g["near"][:] = np.bincount(np.maximum(self.BACK, 0).ravel(), weights=per.ravel(), minlength=SPAN)
        dq, dk = wide(ds @ k), wide(ds.transpose(0, 2, 1) @ q)
        np.matmul(eq.T, dq, out=g["query"])
        g["query"] *= scale
        np.matmul(wide(e).T, dk, out=g["key"])
        np.matmul(wide(e).T, dv, out=g["value"])
        de = dk @ p["key"].T
        de += dv @ p["value"].T
        dz = dh @ p["mix"][:WIDTH].T
        dz += dq @ (p["query"] * scale).T
        de.reshape(e.shape)[:, SPAN - STRIDE :] += dz.reshape(q.shape)
        cells = (x.reshape(-1, 1) * WIDTH + np.arange(WIDTH)).ravel()
        g["embed"][:] = np.bincount(cells, weights=de.ravel(), minlength=g["embed"].size).reshape(g["embed"].shape)
        return self.slope.flat, loss


def tiles(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows dealt to tiles of TILE rows of one group each: the place of each row in the tiles, and each tile's group."""
    many = np.bincount(group, minlength=GROUPS)
    each = -(-many // TILE)
    order = np.argsort(group.astype(np.int8), kind="stable")
    place = np.empty(len(group), dtype=np.int64)
    skipped = (np.cumsum(each) - each) * TILE - (np.cumsum(many) - many)
    place[order] = np.arange(len(group)) + np.repeat(skipped, many)
    return place, np.repeat(np.arange(GROUPS), each)


class Trainer:
    """Adam on a model's weights, in place: a few steps of warming up, then a rate that falls with their root."""

    def __init__(self, model: Model, rate: float, batch: int = 64, seed: int = 0):
        self.model, self.rate, self.batch = model, rate, batch
        self.rng = np.random.default_rng(seed)
        self.first, self.second, self.steps = np.zeros_like(model.flat), np.zeros_like(model.flat), 0
        self.spare = np.empty(SOME, dtype=np.float32)

    def learn(self, x, valid, target, live) -> float:
        """One pass over windows in random order; the mean loss in nats."""
        losses, order = [], self.rng.permutation(len(x))
        for at in range(0, len(order), self.batch):
            i = order[at : at + self.batch]
            grad, loss = self.model.gradient(*(z.take(i, axis=0) for z in (x, valid, target, live)))
            losses.append(loss)
            self.steps += 1
            t = min(self.steps, 1000)
            now = self.rate * min(1.0, t / 20) / np.sqrt(1.0 + self.steps / 1000)
            root = np.sqrt(1 - 0.99**t)
            self._move(grad, np.float32(now * root / (1 - 0.9**t)), np.float32(1e-6 * root))
        return float(np.mean(losses)) if losses else 0.0

    def _move(self, grad: np.ndarray, rate: np.float32, least: np.float32) -> None:
        """A step, some weights at a time, in place, so that their numbers stay in a core's cache. The moments are kept without
        their factors 0.1 and 0.01, which cancel."""
        for at in range(0, len(grad), SOME):
            flat, first, second, new = (z[at : at + SOME] for z in (self.model.flat, self.first, self.second, grad))
            spare = self.spare[: len(new)]
            first *= 0.9
            first += new
            second *= 0.99
            np.multiply(new, new, out=spare)
            second += spare
            np.sqrt(second, out=spare)
            spare += least
            np.divide(first, spare, out=spare)
            spare *= rate
            flat -= spare


def token_scores(model: Model, coding: Coding, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each id. ``ids``: texts laid end to end, each closed by the end id; lengths with it."""
    target = coding.classes[ids]
    before = np.empty(len(ids), dtype=np.int32)
    before[1:] = coding.inputs[ids[:-1]]
    before[np.cumsum(lengths) - lengths] = coding.inputs[coding.end]
    found = coding.within[ids]
    spans, tables = windows(lengths), model.tables()
    for at in range(0, len(spans), BATCH):
        x, valid, scored, live = gather(before, spans[at : at + BATCH])
        got = model.scored(tables, x, valid, target[scored])
        found[scored[live]] += got[live] / np.log(10.0)
    return found


def scores(model: Model, coding: Coding, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each text."""
    if not len(lengths):
        return np.zeros(0)
    return np.add.reduceat(token_scores(model, coding, ids, lengths), np.cumsum(lengths) - lengths)
