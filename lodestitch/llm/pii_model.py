"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Characters come as classes (``codes``). Both directions run in one loop over the places of a batch of equal
windows: arrays are (feature, window), so a step is one small matrix product and a few passes. ``train`` fits
all weights by Adam on the exact CRF likelihood; ``Tagger.spans`` decodes. Most windows hold nothing, and
that is proven before any path is searched: where no tag's gain over "outside" can be positive at any place,
"outside" throughout is the best path.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
HIDDEN = 8
#: Classes of characters: padding, small and capital letters, digits, these signs each, white space, other ASCII, beyond ASCII.
SIGNS = "@._%+-()[]:/\"'=,"
CLASSES = 4 + len(SIGNS) + 4
PAD = 0


def _class_table() -> np.ndarray:
    table = np.full(256, 4 + len(SIGNS) + 3, np.int8)
    for code in range(128):
        c = chr(code)
        table[code] = 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3 if "0" <= c <= "9" else 4 + SIGNS.index(c) if c in SIGNS else 4 + len(SIGNS) + (c == " ") + 2 * (c not in "\t\n\v\f\r ")
    return table


_TABLE = _class_table()


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(points, 255)]


def _squash(x: np.ndarray) -> np.ndarray:
    """In place, a cubic stand-in for tanh that reaches 1 at 1.5 (np.tanh costs several times as much)."""
    np.clip(x, -1.5, 1.5, out=x)
    square = x * x
    square *= -4.0 / 27.0
    square += 1.0
    x *= square
    return x


def _slope(x: np.ndarray) -> np.ndarray:
    return 1.0 - np.minimum(x * x, 2.25) / 2.25


def _activate(z: np.ndarray) -> np.ndarray:
    """In place: gates are cut to 0..1, candidates squashed."""
    gates = z[: 6 * HIDDEN]
    np.clip(gates, 0.0, 1.0, out=gates)
    _squash(z[6 * HIDDEN :])
    return z


def _activation_slope(z: np.ndarray) -> np.ndarray:
    """A gate that is shut or wide open still learns a little."""
    gates = z[: 6 * HIDDEN]
    return np.concatenate([np.where((gates > 0.0) & (gates < 1.0), 1.0, 0.05).astype(np.float32), _slope(z[6 * HIDDEN :])])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def allowed() -> np.ndarray:
    """0 where a tag may follow another, else a large penalty: inside needs its own kind before it."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = -1e4
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return out


@dataclass
class Tagger:
    """Weights: rows of ``recurrent`` and ``inputs`` are input, forget and output gates of both directions,
    then both candidates; a direction's block of ``recurrent`` is zero for the other one."""

    recurrent: np.ndarray  # 8H x 2H
    inputs: np.ndarray  # 8H x classes
    out: np.ndarray  # tags x 2H
    bias: np.ndarray  # tags
    moves: np.ndarray  # tags x tags

    def emissions(self, windows: np.ndarray) -> np.ndarray:
        """(place, tag, window) of windows given as (place, window)."""
        length, count = windows.shape
        h2 = 2 * HIDDEN
        states = np.empty((length, h2, count), np.float32)
        state, cell = np.zeros((h2, count), np.float32), np.zeros((h2, count), np.float32)
        z, fed = np.empty((4 * h2, count), np.float32), np.empty((4 * h2, count), np.float32)
        places = windows.astype(np.intp)
        ahead, behind = _split_rows(self.inputs)
        for t in range(length):
            np.matmul(self.recurrent, state, out=z)
            for g in range(4):
                np.take(ahead[g], places[t], axis=1, out=fed[g * h2 : g * h2 + HIDDEN], mode="clip")
                np.take(behind[g], places[length - 1 - t], axis=1, out=fed[g * h2 + HIDDEN : (g + 1) * h2], mode="clip")
            z += fed
            _activate(z)
            cell *= z[h2 : 2 * h2]
            cell += z[:h2] * z[3 * h2 :]
            state = _squash(cell.copy())
            state *= z[2 * h2 : 3 * h2]
            states[t, :HIDDEN] = state[:HIDDEN]
            states[length - 1 - t, HIDDEN:] = state[HIDDEN:]
        return np.matmul(self.out, states) + self.bias[:, None]

    def spans(self, windows: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(window, start, end, kind, gain over outside) of the best path of every window."""
        scores = self.emissions(windows)
        open_ = np.nonzero(self._may_hold(scores))[0]
        found = []
        for at in range(0, len(open_), 64):
            part = open_[at : at + 64]
            for w, path in zip(part, self._best(scores[:, :, part])):
                found += [(int(w), *s) for s in self._cut(scores[:, :, w], path)]
        return found

    def _may_hold(self, scores: np.ndarray) -> np.ndarray:
        """False for windows whose best path is sure to be "outside" throughout: no stretch of one kind, with
        the best way into it and out of it, gains anything over that."""
        begin, inside = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
        rest = self.moves - self.moves[0, 0]
        enter = rest[:, begin].max(axis=0)[:, None]
        stay = np.maximum(rest[begin, inside], rest[inside, inside])[:, None]
        leave = np.maximum(0.0, np.maximum(rest[begin, 0], rest[inside, 0]))[:, None]
        first, more = scores[:, 1::2] - scores[:, :1] + enter, scores[:, 2::2] - scores[:, :1] + stay
        open_ = first[0].copy()
        most = open_.copy()
        for t in range(1, len(scores)):
            open_ += more[t]
            np.maximum(open_, first[t], out=open_)
            np.maximum(most, open_, out=most)
        return ((most + leave) > 0).any(axis=0)

    def _best(self, scores: np.ndarray) -> np.ndarray:
        length, _, count = scores.shape
        back = np.empty((length, TAGS, count), np.int8)
        best = scores[0] + self._first()[:, None]
        for t in range(1, length):
            through = best[:, None, :] + self.moves[:, :, None]
            back[t] = through.argmax(axis=0)
            best = through.max(axis=0) + scores[t]
        paths = np.empty((count, length), np.int8)
        paths[:, -1] = best.argmax(axis=0)
        every = np.arange(count)
        for t in range(length - 1, 0, -1):
            paths[:, t - 1] = back[t, paths[:, t], every]
        return paths

    def _first(self) -> np.ndarray:
        return self.moves[0]

    def _cut(self, scores: np.ndarray, path: np.ndarray) -> list[tuple[int, int, int, float]]:
        starts = np.nonzero((path > 0) & ((path % 2 == 1) | (np.r_[0, path[:-1]] == 0)))[0]
        out = []
        for s in starts.tolist():
            kind, e = (int(path[s]) - 1) // 2, s + 1
            while e < len(path) and path[e] == 2 + 2 * kind:
                e += 1
            places = np.arange(s, e)
            gain = float((scores[places, path[s:e]] - scores[places, 0]).sum())
            steps = np.r_[0 if s == 0 else path[s - 1], path[s:e], 0 if e == len(path) else path[e]]
            gain += float((self.moves[steps[:-1], steps[1:]] - self.moves[0, 0]).sum())
            out.append((s, e, kind, gain))
        return out


def _split_rows(weights: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The gates' rows of the direction ahead and of the one behind."""
    h2 = 2 * HIDDEN
    return [np.ascontiguousarray(weights[g * h2 : g * h2 + HIDDEN]) for g in range(4)], [np.ascontiguousarray(weights[g * h2 + HIDDEN : (g + 1) * h2]) for g in range(4)]


def _blocks() -> np.ndarray:
    """1 where ``recurrent`` may be non-zero."""
    ahead = (np.arange(8 * HIDDEN) // HIDDEN) % 2 == 0
    return (ahead[:, None] == (np.arange(2 * HIDDEN) < HIDDEN)[None]).astype(np.float32)


def _gradients(model: Tagger, windows: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of (place, window) tags, and its gradients."""
    length, count = windows.shape
    h2 = 2 * HIDDEN
    z_all, cells = np.empty((length, 4 * h2, count), np.float32), np.zeros((length + 1, h2, count), np.float32)
    gates, held = np.empty_like(z_all), np.zeros((length + 1, h2, count), np.float32)
    states = np.empty((length, h2, count), np.float32)
    fed_by = np.concatenate([windows[:, None], windows[::-1, None]], axis=1)
    row_ahead = np.repeat((np.arange(8 * HIDDEN) // HIDDEN) % 2 == 0, 1)
    for t in range(length):
        z = model.recurrent @ held[t]
        z[row_ahead] += model.inputs[row_ahead][:, fed_by[t, 0]]
        z[~row_ahead] += model.inputs[~row_ahead][:, fed_by[t, 1]]
        z_all[t] = z
        g = gates[t] = _activate(z.copy())
        cells[t + 1] = g[h2 : 2 * h2] * cells[t] + g[:h2] * g[3 * h2 :]
        held[t + 1] = _squash(cells[t + 1].copy()) * g[2 * h2 : 3 * h2]
        states[t, :HIDDEN] = held[t + 1, :HIDDEN]
        states[length - 1 - t, HIDDEN:] = held[t + 1, HIDDEN:]
    scores = np.matmul(model.out, states) + model.bias[:, None]

    # Forward and backward sums of the CRF.
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = scores[0] + model.moves[0][:, None]
    for t in range(1, length):
        alpha[t] = _log_sum(alpha[t - 1][:, None] + model.moves[:, :, None], 0) + scores[t]
    for t in range(length - 2, -1, -1):
        beta[t] = _log_sum(model.moves[:, :, None] + (scores[t + 1] + beta[t + 1])[None], 1)
    total = _log_sum(alpha[-1], 0)
    every = np.arange(count)
    gold = model.moves[0][tags[0]] + scores[0, tags[0], every]
    d_moves = np.zeros_like(model.moves)
    np.add.at(d_moves[0], tags[0], -1.0)
    d_scores = np.exp(alpha + beta - total)
    d_moves[0] += d_scores[0].sum(axis=1)
    for t in range(1, length):
        gold = gold + model.moves[tags[t - 1], tags[t]] + scores[t, tags[t], every]
        pair = np.exp(alpha[t - 1][:, None] + model.moves[:, :, None] + (scores[t] + beta[t])[None] - total)
        d_moves += pair.sum(axis=2)
        np.add.at(d_moves, (tags[t - 1], tags[t]), -1.0)
    for t in range(length):
        d_scores[t, tags[t], every] -= 1.0
    loss = float((total - gold).mean())

    d_out = np.einsum("tkb,thb->kh", d_scores, states)
    d_states = np.matmul(model.out.T, d_scores)
    d_recurrent, d_inputs = np.zeros_like(model.recurrent), np.zeros_like(model.inputs)
    d_held, d_cell = np.zeros((h2, count), np.float32), np.zeros((h2, count), np.float32)
    one_hot = np.eye(CLASSES, dtype=np.float32)
    for t in range(length - 1, -1, -1):
        d_h = d_held.copy()
        d_h[:HIDDEN] += d_states[t, :HIDDEN]
        d_h[HIDDEN:] += d_states[length - 1 - t, HIDDEN:]
        g = gates[t]
        squashed = _squash(cells[t + 1].copy())
        d_cell = d_cell + d_h * g[2 * h2 : 3 * h2] * _slope(cells[t + 1])
        d_g = np.concatenate([d_cell * g[3 * h2 :], d_cell * cells[t], d_h * squashed, d_cell * g[:h2]])
        d_z = d_g * _activation_slope(z_all[t])
        d_cell = d_cell * g[h2 : 2 * h2]
        d_recurrent += d_z @ held[t].T
        d_inputs[row_ahead] += d_z[row_ahead] @ one_hot[fed_by[t, 0]]
        d_inputs[~row_ahead] += d_z[~row_ahead] @ one_hot[fed_by[t, 1]]
        d_held = model.recurrent.T @ d_z
    grads = [d_recurrent * _blocks(), d_inputs, d_out, d_scores.sum(axis=(0, 2)), d_moves * (allowed() == 0)]
    return loss, [(x / count).astype(np.float32) for x in grads]


def train(windows: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Tagger:
    """A tagger of (window, place) classes and tags; the same input gives the same weights."""
    rng = np.random.default_rng(seed)
    size = 0.3
    inputs = rng.normal(0, size, (8 * HIDDEN, CLASSES)).astype(np.float32)
    inputs[: 6 * HIDDEN] += 0.5
    model = Tagger(
        (rng.normal(0, size, (8 * HIDDEN, 2 * HIDDEN)) * _blocks()).astype(np.float32), inputs, rng.normal(0, size, (TAGS, 2 * HIDDEN)).astype(np.float32), np.zeros(TAGS, np.float32), allowed()
    )
    weights = [model.recurrent, model.inputs, model.out, model.bias, model.moves]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step, steps = 0, epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            _, grads = _gradients(model, windows[part].T, tags[part].T)
            norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
            step += 1
            pace = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for w, g, m, v in zip(weights, grads, first, second):
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return model
