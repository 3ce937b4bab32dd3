"""A gated recurrent network whose softmax is factored by classes, in numpy.

A symbol is a class of its own (0 to ``own`` - 1) or one of ``MEMBERS`` members of a class: P(symbol | state) =
P(class | state) P(member | class, state), both softmaxes over the state. ``END`` (0) closes every sequence and, as
input, opens the next one with a zero state; inputs are classes. Many sequences are laid end to end in lanes;
state is carried from window to window, so that likelihoods are those of whole sequences, while gradients stop at
a window's start (truncated backpropagation).
"""

from __future__ import annotations

import ctypes
import functools
import heapq

import numpy as np

END = 0
HIDDEN, WINDOW, LANES, MEMBERS = 16, 24, 512, 32
#: Rows of the output layer that are worked on together, so that they stay in a core's cache; rows of a class's product.
ROWS, PIECE = 512, 32
#: Largest logit that is exponentiated as it is.
LARGEST = 60.0


@functools.cache
def one_thread() -> None:
    """Keep numpy's OpenBLAS to one thread in this process: on matrices this small, more of them spin more than they work."""
    try:
        with open("/proc/self/maps") as f:
            libraries = {line.split()[-1] for line in f if "openblas" in line}
    except OSError:
        return
    for path in libraries:
        library = ctypes.CDLL(path)
        for name in ("openblas_set_num_threads", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "scipy_openblas_set_num_threads64_"):
            if hasattr(library, name):
                getattr(library, name)(1)


def fresh(own: int, shared: int = 0, hidden: int = HIDDEN, seed: int = 0) -> dict[str, np.ndarray]:
    """Parameters for ``own`` classes of one symbol and ``shared`` classes of ``MEMBERS`` symbols."""
    r = np.random.default_rng(seed)
    classes = own + shared
    return {
        "E": r.normal(0, 0.3, (classes, 3 * hidden)).astype(np.float32),
        "U": r.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32),
        "b": np.zeros(3 * hidden, np.float32),
        "W": r.normal(0, 0.3, (hidden, classes)).astype(np.float32),
        "o": np.zeros(classes, np.float32),
        "V": r.normal(0, 0.1, (shared, hidden, MEMBERS)).astype(np.float32),
        "q": np.zeros((shared, MEMBERS), np.float32),
    }


def own_classes(p: dict) -> int:
    return p["W"].shape[1] - len(p["q"])


def class_of(p: dict, symbols: np.ndarray) -> np.ndarray:
    own = own_classes(p)
    return np.where(symbols < own, symbols, own + (symbols - np.minimum(symbols, own)) // MEMBERS).astype(np.uint8)


def flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflat(values: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def lanes(sequences: list[np.ndarray], count: int = LANES):
    """Targets (steps, lanes), lanes by length, and for each sequence its lane and first step."""
    count = max(1, min(count, len(sequences)))
    heap = [(0, k) for k in range(count)]
    held: list[list[int]] = [[] for _ in range(count)]
    for i in sorted(range(len(sequences)), key=lambda i: -len(sequences[i])):
        n, k = heapq.heappop(heap)
        held[k].append(i)
        heapq.heappush(heap, (n + len(sequences[i]), k))
    held.sort(key=lambda ids: -sum(len(sequences[i]) for i in ids))
    loads = [sum(len(sequences[i]) for i in ids) for ids in held]
    targets = np.full((loads[0] if loads else 0, count), END, np.uint16)
    places = [(0, 0)] * len(sequences)
    for k, ids in enumerate(held):
        at = 0
        for i in ids:
            targets[at : at + len(sequences[i]), k] = sequences[i]
            places[i] = (k, at)
            at += len(sequences[i])
    return targets, np.array(loads), places


def _blocks(x: np.ndarray) -> np.ndarray:
    """(rows, 3 hidden) as (3, rows, hidden)."""
    return np.ascontiguousarray(x.reshape(len(x), 3, -1).transpose(1, 0, 2))


def _forward(p: dict, x: np.ndarray, h: np.ndarray, keep: bool):
    """States after each input of a window; with ``keep`` also what the backward pass needs."""
    steps, b = x.shape
    n = h.shape[1]
    # The gates are 1 / (1 + exp(-a)): their inputs come with the sign already turned. Each gate is a block of its
    # own, so that what runs over a gate's values runs over one piece of memory.
    turn = np.where(np.arange(3 * n) < 2 * n, np.float32(-1), np.float32(1))
    table, U = _blocks((p["E"] + p["b"]) * turn), _blocks(p["U"] * turn)
    gates = [t[x] for t in table]
    open_ = (x != END).astype(np.float32)[:, :, None]
    states, kept = np.empty((steps, b, n), np.float32), []
    a, zr, d = np.empty((3, b, n), np.float32), np.empty((2, b, n), np.float32), np.empty((b, n), np.float32)
    for t in range(steps):
        if keep:
            a, zr, d = np.empty_like(a), np.empty_like(zr), np.empty_like(d)
        h0 = h * open_[t]
        np.matmul(h0, U, out=a)
        z, r = zr
        np.add(a[0], gates[0][t], out=z)
        np.add(a[1], gates[1][t], out=r)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        np.multiply(r, a[2], out=d)
        d += gates[2][t]
        np.tanh(d, out=d)
        h = states[t]
        np.subtract(h0, d, out=h)
        h *= z
        h += d
        if keep:
            kept.append((h0, a[2], z, r, d))
    return states, h, open_, kept


class Output:
    """The factored softmax over a window's states (rows, hidden) and their symbols."""

    def __init__(self, p: dict):
        self.p, self.own = p, own_classes(p)
        self.safe = bool(np.abs(p["W"]).sum(axis=0).max() + np.abs(p["o"]).max() < LARGEST)

    def classes(self, states: np.ndarray):
        """Exponentials of the class logits and their sums."""
        e = states @ self.p["W"]
        e += self.p["o"]
        if not self.safe:
            np.minimum(e, LARGEST, out=e)
        np.exp(e, out=e)
        return e, e @ np.ones(e.shape[1], np.float32)

    def members(self, states: np.ndarray, symbols: np.ndarray):
        """Products by class, in pieces of ``PIECE`` rows: the rows with members, their place among the pieces, the
        class of each piece, its states, probabilities of the members, and the member of each row."""
        rows = np.flatnonzero(symbols >= self.own)
        if not len(rows):
            return None
        symbols = symbols[rows].astype(np.int64) - self.own
        kind, member = (symbols // MEMBERS).astype(np.uint8), symbols % MEMBERS
        order = np.argsort(kind, kind="stable")
        rows, kind, member = rows[order], kind[order], member[order]
        count = np.bincount(kind, minlength=len(self.p["q"]))
        pieces = -(-count // PIECE)
        first = np.cumsum(pieces) - pieces
        place = np.arange(len(rows)) + np.repeat(first * PIECE - (np.cumsum(count) - count), count)
        of = np.repeat(np.arange(len(count)), pieces)
        laid = np.zeros((len(of) * PIECE, states.shape[1]), np.float32)
        laid[place] = states[rows]
        laid = laid.reshape(len(of), PIECE, -1)
        e = np.matmul(laid, self.p["V"][of])
        e += self.p["q"][of][:, None, :]
        e -= e.max(axis=2, keepdims=True)
        np.exp(e, out=e)
        e /= e.sum(axis=2, keepdims=True)
        return rows, place, of, laid, e, member

    def log(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Natural log-probability of each row's symbol."""
        out, kind = np.empty(len(states), np.float32), class_of(self.p, symbols)
        for i in range(0, len(states), ROWS):
            e, total = self.classes(states[i : i + ROWS])
            out[i : i + ROWS] = e[np.arange(len(e)), kind[i : i + ROWS]] / total
        np.log(out, out=out)
        found = self.members(states, symbols)
        if found is not None:
            rows, place, _, _, e, member = found
            out[rows] += np.log(np.maximum(e.reshape(-1, MEMBERS)[place, member], 1e-30))
        return out

    def gradients(self, states: np.ndarray, symbols: np.ndarray):
        """Of the mean negative log-probability: by parameter, and by state."""
        p, n, kind = self.p, len(states), class_of(self.p, symbols)
        g = {"W": np.zeros_like(p["W"]), "o": np.zeros_like(p["o"]), "V": np.zeros_like(p["V"]), "q": np.zeros_like(p["q"])}
        back, turned = np.empty_like(states), np.ascontiguousarray(p["W"].T)
        for i in range(0, n, ROWS):
            s = states[i : i + ROWS]
            e, total = self.classes(s)
            total *= n
            np.reciprocal(total, out=total)
            e *= total[:, None]
            e[np.arange(len(e)), kind[i : i + ROWS]] -= 1 / n
            g["W"] += s.T @ e
            g["o"] += np.ones(len(e), np.float32) @ e
            back[i : i + ROWS] = e @ turned
        found = self.members(states, symbols)
        if found is not None:
            rows, place, of, laid, e, member = found
            d = np.zeros((len(of) * PIECE, MEMBERS), np.float32)
            d[place] = e.reshape(-1, MEMBERS)[place]
            d[place, member] -= 1
            d /= n
            d = d.reshape(e.shape)
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            g["V"][of[starts]] = np.add.reduceat(np.matmul(laid.transpose(0, 2, 1), d), starts, axis=0)
            g["q"][of[starts]] = np.add.reduceat(d.sum(axis=1), starts, axis=0)
            back[rows] += np.matmul(d, p["V"][of].transpose(0, 2, 1)).reshape(-1, states.shape[1])[place]
        return g, back


def _inputs(p: dict, targets: np.ndarray) -> np.ndarray:
    if not len(targets):
        return targets.astype(np.uint8)
    return np.vstack([np.full((1, targets.shape[1]), END, np.uint8), class_of(p, targets[:-1])])


def log_likelihoods(p: dict, sequences: list[np.ndarray], count: int = LANES) -> np.ndarray:
    """Natural log-likelihood of each sequence, which ends with END."""
    targets, loads, places = lanes(sequences, count)
    inputs, output = _inputs(p, targets), Output(p)
    h = np.zeros((targets.shape[1], p["U"].shape[0]), np.float32)
    got = np.zeros(targets.shape, np.float32)
    for at in range(0, len(targets), WINDOW):
        live = int(np.searchsorted(-loads, -at, side="left"))
        y = targets[at : at + WINDOW, :live]
        states, last, _, _ = _forward(p, inputs[at : at + WINDOW, :live], h[:live], False)
        h[:live] = last
        got[at : at + WINDOW, :live] = output.log(states.reshape(-1, states.shape[2]), y.ravel()).reshape(y.shape)
    return np.array([got[at : at + len(s), k].sum(dtype=np.float64) for s, (k, at) in zip(sequences, places, strict=True)])


class Trainer:
    """Adam over windows of lanes."""

    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.t = {k: v.copy() for k, v in p.items()}, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.tokens = 0

    def gradients(self, x: np.ndarray, y: np.ndarray, h: np.ndarray):
        """Of a window's mean negative log-probability, from input classes, symbols and first states; and the last states."""
        p, (steps, b), n = self.p, x.shape, h.shape[1]
        states, last, open_, kept = _forward(p, x, h, True)
        g, back = Output(p).gradients(states.reshape(-1, n), y.ravel())
        dh_out = back.reshape(steps, b, n)
        dg = np.empty((3, steps, b, n), np.float32)
        dU = np.zeros((3, n, n), np.float32)
        dh, turned = np.zeros((b, n), np.float32), np.ascontiguousarray(_blocks(p["U"]).transpose(0, 2, 1))
        da, w, part = np.empty((b, n), np.float32), np.empty((b, n), np.float32), np.empty((b, n), np.float32)
        for t in range(steps - 1, -1, -1):
            h0, an, z, r, c = kept[t]
            dh += dh_out[t]
            dz, dr, dc = dg[:, t]
            np.subtract(1, z, out=w)
            # dz = dh (h0 - c) z (1 - z)
            np.subtract(h0, c, out=dz)
            dz *= dh
            dz *= z
            dz *= w
            # dc = dh (1 - z) (1 - c c)
            w *= dh
            np.multiply(c, c, out=dc)
            np.subtract(1, dc, out=dc)
            dc *= w
            # dr = dc a r (1 - r)
            np.multiply(dc, r, out=da)
            np.subtract(1, r, out=dr)
            dr *= da
            dr *= an
            dh *= z
            for k, d in enumerate((dz, dr, da)):
                dU[k] += h0.T @ d
                dh += np.matmul(d, turned[k], out=part)
            dh *= open_[t]
        flat_dg = dg.reshape(3, -1, n)
        # Sum the gates' gradients by input class: sort once, then add runs.
        order = np.argsort(x.ravel(), kind="stable")
        names, starts = np.unique(x.ravel()[order], return_index=True)
        g["E"] = np.zeros_like(p["E"])
        for k, d in enumerate(flat_dg):
            g["E"][names, k * n : (k + 1) * n] = np.add.reduceat(d[order], starts, axis=0)
        g["b"], g["U"] = g["E"].sum(axis=0), dU.transpose(1, 0, 2).reshape(n, 3 * n)
        return g, last

    def learn(self, sequences: list[np.ndarray], count: int = LANES) -> None:
        """One pass over whole sequences."""
        targets, loads, _ = lanes(sequences, count)
        if not len(targets):
            return
        inputs = _inputs(self.p, targets)
        h = np.zeros((targets.shape[1], self.p["U"].shape[0]), np.float32)
        for at in range(0, len(targets), WINDOW):
            live = int(np.searchsorted(-loads, -at, side="left"))
            g, last = self.gradients(inputs[at : at + WINDOW, :live], targets[at : at + WINDOW, :live], h[:live])
            h[:live] = last
            self.t += 1
            for k, d in g.items():
                self.m[k] += 0.1 * (d - self.m[k])
                self.v[k] += 0.001 * (d * d - self.v[k])
                self.p[k] -= self.rate / (1 - 0.9**self.t) * self.m[k] / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
        self.tokens += int(loads.sum())
