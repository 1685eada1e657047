"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, carried state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np

Parameters = dict[str, np.ndarray]


def class_bounds(counts: np.ndarray, classes: int) -> np.ndarray:
    """Bounds of ``classes`` runs of words, by falling count, of about equal sums of root counts."""
    mass = np.sqrt(counts + 1.0).cumsum()
    cuts = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes, side="left") + 1
    return np.unique(np.concatenate([[0], np.minimum(cuts, len(counts)), [len(counts)]]))


class GruModel:
    """Words 0 .. G-1 by falling count lie in classes; ids from G on are classes of rare words, each a whole class.

    The probability of an id is that of its class given the state, times, for a word, that of the
    word in its class. One more id stands before the first word of a text.
    """

    def __init__(self, counts: np.ndarray, rare: np.ndarray, *, classes: int = 32, hidden: int = 32, seed: int = 0):
        self.words, self.rare, self.hidden = len(counts), len(rare), hidden
        self.bounds = class_bounds(counts, min(classes, len(counts)))
        self.classes = len(self.bounds) - 1
        self.start = self.words + self.rare
        self.halves = np.repeat(np.array([0.5, 1], np.float32), [2 * hidden, hidden])
        of_word = np.searchsorted(self.bounds, np.arange(self.words), side="right") - 1
        self.class_of = np.concatenate([of_word, self.classes + np.arange(self.rare), [0]])
        rng = np.random.default_rng(seed)
        mass = np.add.reduceat(counts + 1.0, self.bounds[:-1])
        all_mass = np.concatenate([mass, rare])
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        # The biases say what single words say, so an untrained model is as good as their counts.
        self.parameters: Parameters = {
            "E": draw(self.start + 1, hidden, scale=0.1),
            "W": draw(hidden, 3 * hidden, scale=hidden**-0.5),
            "U": draw(hidden, 3 * hidden, scale=hidden**-0.5),
            "b": np.zeros(3 * hidden, np.float32),
            "c": np.zeros(hidden, np.float32),
            "O": draw(hidden, self.classes + self.rare, scale=0.01),
            "o": np.log(all_mass / all_mass.sum()).astype(np.float32),
            "P": draw(hidden, self.words, scale=0.01),
            "p": np.log((counts + 1.0) / mass[of_word]).astype(np.float32),
        }

    def inputs(self, ids: np.ndarray | slice = slice(None)) -> np.ndarray:
        """What ids give to the gates; a logistic gate is half a tanh of half its input, so the gates' inputs are halved."""
        return (self.parameters["E"][ids] @ self.parameters["W"] + self.parameters["b"]) * self.halves

    def window(self, ids: np.ndarray, targets: np.ndarray, mask: np.ndarray, state: np.ndarray, train: bool, inputs: np.ndarray | None = None):
        """Log probabilities of the targets (steps by lanes), the state after, and the gradients if ``train``.

        The state that comes in is a constant: gradients stop at the window's edge. Where the weights stay, ``inputs`` of all ids may be
        given, without ``train``.
        """
        p, n = self.parameters, self.hidden
        steps, lanes = ids.shape
        small = np.int16 if self.start < 1 << 15 else np.int64
        flat = ids.ravel().astype(small)
        if inputs is None:
            # Equal ids side by side: their inputs are made once, and what they hand back is summed once.
            order = np.argsort(flat, kind="stable")
            new = np.concatenate([[True], np.diff(flat[order]) != 0])
            starts = np.flatnonzero(new)
            met = flat[order[starts]].astype(np.int64)
            inputs, flat = self.inputs(met), np.empty(len(order), np.int64)
            flat[order] = np.cumsum(new) - 1
        x = inputs.take(flat, 0).reshape(steps, lanes, 3 * n)
        halved = p["U"] * self.halves
        states = np.empty((steps + 1, lanes, n), np.float32)
        states[0] = state
        kept = steps if train else 1
        gates = np.empty((kept, lanes, 2 * n), np.float32)
        fresh, inner = np.empty((2, kept, lanes, n), np.float32)
        for t in range(steps):
            h, g, new, own = states[t], gates[t % kept], fresh[t % kept], inner[t % kept]
            hu = h @ halved
            np.add(x[t, :, : 2 * n], hu[:, : 2 * n], out=g)
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            np.add(hu[:, 2 * n :], p["c"], out=own)
            np.multiply(g[:, n:], own, out=new)
            new += x[t, :, 2 * n :]
            np.tanh(new, out=new)
            after = np.subtract(h, new, out=states[t + 1])
            after *= g[:, :n]
            after += new
        after = states[-1]
        # By target: a class is one run of rows. A last column of ones meets the biases.
        rows = np.flatnonzero(mask)
        goal = targets.ravel()[rows]
        by_goal = np.argsort(goal.astype(small), kind="stable")
        rows, goal = rows[by_goal], goal[by_goal]
        out = np.ones((len(rows), n + 1), np.float32)
        out[:, :n] = states[1:].reshape(-1, n).take(rows, 0)
        found, d_out, grads = self._output(out, goal, train)
        if train:
            d_states = np.zeros((steps * lanes, n), np.float32)
            d_states[rows] = d_out[:, :n]
            d_x = self._back(d_states.reshape(steps, lanes, n), states, gates, fresh, inner, grads)
            summed = _run_sums(d_x.take(order, 0), starts)
            grads["W"], grads["b"] = p["E"][met].T @ summed, summed.sum(0)
            grads["E"] = np.zeros_like(p["E"])
            grads["E"][met] = summed @ p["W"].T
        log_p = np.zeros(steps * lanes)
        log_p[rows] = found
        return log_p.reshape(steps, lanes), after, grads

    def _output(self, out: np.ndarray, goal: np.ndarray, train: bool, shifted: bool = False):
        """Log probabilities of ``goal``, which ascends, after the states ``out``, and, if ``train``, the gradients of minus their mean.

        Exponentials are of plain values; only if a sum comes near the range of floats are all rows ``shifted`` by their maximum.
        """
        p, n = self.parameters, len(goal)
        top, low = np.vstack([p["O"], p["o"]]), np.vstack([p["P"], p["p"]])
        of = self.class_of[goal]
        # Values of the classes by row, and of the words of a row's class in one run, row after row.
        values, at = out @ top, np.arange(n) * top.shape[1] + of
        inner = np.searchsorted(goal, self.words)
        own = of[:inner]
        widths = np.diff(self.bounds)[own]
        ends = widths.cumsum()
        firsts = ends - widths
        inside = np.empty(ends[-1] if inner else 0, values.dtype)
        edges = np.searchsorted(own, np.arange(self.classes + 1)).tolist()
        bounds, cuts = self.bounds.tolist(), [0, *ends.tolist()]
        blocks = []
        for c in range(self.classes):
            first, last, left, right = edges[c], edges[c + 1], bounds[c], bounds[c + 1]
            if first < last:
                block = inside[cuts[first] : cuts[last]].reshape(last - first, right - left)
                np.matmul(out[first:last], low[:, left:right], out=block)
                blocks.append((first, last, left, right, block))
        if shifted:
            values -= values.max(1, keepdims=True)
            for *_, block in blocks:
                block -= block.max(1, keepdims=True)
        inside_at = firsts + goal[:inner] - self.bounds[own]
        found = values.ravel()[at]
        found[:inner] += inside[inside_at]
        with np.errstate(over="ignore"):
            np.exp(values, out=values)
            np.exp(inside, out=inside)
            total = values @ np.ones(values.shape[1], values.dtype)
            within = np.add.reduceat(inside, firsts) if inner else inside
        if not shifted and any(len(t) and not (1e-30 < t.min() and t.max() < 1e30) for t in (total, within)):
            return self._output(out, goal, train, True)
        found -= np.log(total)
        found[:inner] -= np.log(within)
        if not train:
            return found, None, {}
        scale = np.float32(1 / max(1, n))
        values *= (scale / total)[:, None]
        values.reshape(-1)[at] -= scale
        inside *= np.repeat(scale / within, widths)
        inside[inside_at] -= scale
        d_top, d_low = out.T @ values, np.zeros_like(low)
        d_out = values @ top.T
        for first, last, left, right, block in blocks:
            np.matmul(out[first:last].T, block, out=d_low[:, left:right])
            d_out[first:last] += block @ low[:, left:right].T
        return found, d_out, {"O": d_top[:-1], "o": d_top[-1], "P": d_low[:-1], "p": d_low[-1]}

    def _back(self, d_states, states, gates, fresh, inner, grads) -> np.ndarray:
        """Gradients of the inputs, those of ``U`` and ``c`` into ``grads``; ``d_states`` comes to hold all that reaches a state."""
        steps, lanes, n = d_states.shape
        z, r = gates[:, :, :n], gates[:, :, n:]
        fall = 1 - fresh * fresh
        fall *= 1 - z
        # What a state hands to the gates, for each unit of its own gradient.
        hand = np.empty((steps, lanes, 3, n), np.float32)
        np.multiply(states[:-1] - fresh, z * (1 - z), out=hand[:, :, 0])
        np.multiply(fall, r, out=hand[:, :, 2])
        np.multiply(hand[:, :, 2] * inner, 1 - r, out=hand[:, :, 1])
        turned = np.ascontiguousarray(self.parameters["U"].T)
        d_h = np.zeros((lanes, n), np.float32)
        for t in range(steps - 1, -1, -1):
            d = d_states[t]
            d += d_h
            hand[t] *= d[:, None]
            d_h = d * z[t]
            d_h += hand[t].reshape(lanes, 3 * n) @ turned
        d_u = hand.reshape(-1, 3 * n)
        grads["U"] = states[:-1].reshape(-1, n).T @ d_u
        grads["c"] = d_u[:, 2 * n :].sum(0)
        # Before the reset gate, the last third of a step's input.
        np.multiply(d_states, fall, out=hand[:, :, 2])
        return d_u


def _run_sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at ``starts``; pairs of floats are added as one complex number, which takes half the steps."""
    if rows.shape[1] % 2 or rows.dtype != np.float32:
        return np.add.reduceat(rows, starts, axis=0)
    return np.add.reduceat(rows.view(np.complex64), starts, axis=0).view(np.float32)


def windows(texts: Sequence[np.ndarray], start: int, lanes: int, steps: int, *, stretched: bool = False) -> Iterator[tuple]:
    """Windows over many texts at once: each lane runs through a text to its end, then takes the next one.

    Yields the texts in the lanes (their number, -1 for none), the lanes in use, inputs, targets, mask and which lanes
    begin a text. Lanes that ran dry at the end are left out; if ``stretched``, the others then take more steps instead.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    firsts = sizes.cumsum() - sizes
    tokens = np.concatenate([*texts, np.zeros(1, np.int32)])
    before = np.concatenate([[start], tokens[:-1]]).astype(tokens.dtype)
    before[firsts] = start
    owner, at, left, taken = np.full(lanes, -1), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), 0
    while True:
        free = np.flatnonzero(left <= 0)
        owner[free] = -1
        some = free[: len(texts) - taken]
        new = np.arange(taken, taken + len(some))
        taken += len(some)
        owner[some], at[some], left[some] = new, firsts[new], sizes[new]
        begins = np.zeros(lanes, bool)
        begins[some] = True
        live = np.flatnonzero(owner >= 0)
        if not len(live):
            return
        wide = min(steps * (lanes // len(live)), max(steps, int(left[live].max()))) if stretched else steps
        ahead = np.arange(wide)[:, None]
        mask, places = ahead < left[live], np.minimum(at[live] + ahead, len(tokens) - 1)
        yield owner, live, np.where(mask, before[places], start), tokens[places], mask, begins
        at += wide
        left -= wide


def score_texts(model: GruModel, texts: list[np.ndarray], *, lanes: int = 256, steps: int = 32) -> np.ndarray:
    """Natural log probability of each text, its state carried from window to window.

    Longest texts go first, so that lanes end together; the order does not change a score.
    """
    order = np.array(sorted(range(len(texts)), key=lambda i: -len(texts[i])), np.int64)
    total, state, inputs = np.zeros(len(texts)), np.zeros((lanes, model.hidden), np.float32), model.inputs()
    for owner, live, ids, targets, mask, begins in windows([texts[i] for i in order], model.start, lanes, steps, stretched=True):
        state[begins] = 0
        log_p, after, _ = model.window(ids, targets, mask, state[live], False, inputs)
        state[live] = after
        total[order[owner[live]]] += log_p.sum(0)
    return total


class Trainer:
    """Adam over windows of a stream of texts, the state carried on between a text's windows."""

    def __init__(self, model: GruModel, *, rate: float = 0.006):
        self.model, self.rate, self.n, self.tokens = model, rate, 0, 0
        # All weights in one row, of which the model's are views.
        self.weights = np.concatenate([v.ravel() for v in model.parameters.values()])
        ends = np.cumsum([v.size for v in model.parameters.values()])
        model.parameters = {
            k: self.weights[end - v.size : end].reshape(v.shape) for (k, v), end in zip(model.parameters.items(), ends)
        }
        self.first, self.second, self.room = (np.zeros_like(self.weights) for _ in range(3))

    def learn(self, texts: Iterable[np.ndarray], *, lanes: int = 64, steps: int = 32) -> None:
        state = np.zeros((lanes, self.model.hidden), np.float32)
        for _, live, ids, targets, mask, begins in windows(list(texts), self.model.start, lanes, steps):
            state[begins] = 0
            _, after, grads = self.model.window(ids, targets, mask, state[live], True)
            state[live] = after
            self.tokens += int(mask.sum())
            # Windows that few texts are left to fill must not outweigh full ones.
            self._step(grads, mask.sum() / (lanes * steps))

    def _step(self, grads: Parameters, weight: float) -> None:
        self.n += 1
        g, room = np.concatenate([grads[k].ravel() for k in self.model.parameters]), self.room
        g *= min(1.0, 1.0 / (float(np.sqrt(g @ g)) + 1e-8))
        rate = float(self.rate * weight * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n))
        self.first *= 0.9
        self.first += np.multiply(g, 0.1, out=room)
        self.second *= 0.999
        np.multiply(g, g, out=g)
        g *= 0.001
        self.second += g
        np.sqrt(self.second, out=g)
        g += 1e-6
        np.divide(self.first, g, out=g)
        g *= rate
        self.weights -= g
