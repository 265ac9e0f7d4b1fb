"""A small causal self-attention language model in numpy: windows, forward pass, training, scoring."""

from __future__ import annotations

import numpy as np

WINDOW, OVERLAP, WIDTH, HIDDEN = 32, 4, 24, 32
#: The softmax is a tree: the first HEAD ranks and the branches, then FAN twigs in a branch, then FAN ranks in a twig.
HEAD, FAN = 128, 32
END = 0  # the rank of the end of a text, which also stands before its first token
LOG10_E = float(np.log10(np.e))
_SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_NEVER = np.float32(-80.0)  # the bias of an output that stands for no rank

Weights = dict[str, np.ndarray]


def _ones(n: int) -> np.ndarray:
    """To sum rows by a product, which is faster than sum()."""
    return np.ones(n, np.float32)


def branches(size: int) -> int:
    return max(1, -(-(size - HEAD) // FAN**2))


def output_masses(mass: np.ndarray) -> list[np.ndarray]:
    """Masses of the tree's outputs: the head's, the twigs' by branch, and the ranks' by twig; none is 0 but where no rank stands."""
    n = branches(len(mass))
    rest = np.zeros(n * FAN**2)
    rest[: max(0, len(mass) - HEAD)] = mass[HEAD:]
    leaves = rest.reshape(n * FAN, FAN)
    twigs = leaves.sum(1).reshape(n, FAN)
    head = np.zeros(HEAD)
    head[: len(mass)] = mass[:HEAD]
    return [np.r_[head, twigs.sum(1)][None, :], twigs, leaves]


def start_weights(mass: np.ndarray, seed: int = 1) -> Weights:
    """Small random weights for ranks of these masses (above 0); output biases are their logarithms."""
    rng = np.random.default_rng(seed)
    small = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    w = {"E": small(0.15, len(mass), WIDTH), "P": small(0.015, WINDOW, WIDTH), "c1": np.zeros(HIDDEN, np.float32)}
    w |= {"Wqkv": small(0.15, WIDTH, 3 * WIDTH), "Wo": small(0.015, WIDTH, WIDTH), "W1": small(0.15, WIDTH, HIDDEN), "W2": small(0.015, HIDDEN, WIDTH)}
    for level, own in enumerate(output_masses(mass)):
        total = own.sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            bias = np.where(own > 0, np.log(own / total), _NEVER)
        w[f"U{level}"] = small(0.01, len(own), WIDTH + 1, own.shape[1])
        w[f"U{level}"][:, WIDTH] = bias
    return w


def bigram_weights(w: Weights, pairs: np.ndarray, smoothing: float = 30.0) -> Weights:
    """Weights that start from a bigram model: embeddings and the head's outputs factor its log-odds against the biases.

    `pairs` counts ranks (rows: before) by the head's outputs (columns: after). What a softmax can't tell from one pair is
    drawn to its bias. Without any pair the weights stay as they are.
    """
    if not pairs.any():
        return w
    w = {k: v.copy() for k, v in w.items()}
    p = np.exp(w["U0"][0, WIDTH].astype(np.float64))
    p = np.maximum(p / p.sum(), 1e-12)
    total = pairs.sum(1, keepdims=True)
    odds = np.log((pairs + smoothing * p) / (total + smoothing) / p)
    before, after = np.sqrt(total + 1.0), np.sqrt(p * total.sum() + 1.0)
    m = before * odds * after
    s, u = np.linalg.eigh(m.T @ m)
    u = u[:, ::-1][:, :WIDTH]
    root = np.sqrt(np.sqrt(np.maximum(s[::-1][:WIDTH], 1e-12)))
    left, right = (m @ u) / root / before, (u * root).T / after
    balance = np.sqrt(np.linalg.norm(right) / max(1e-9, np.linalg.norm(left)))
    w["E"] = (left * balance).astype(np.float32)
    w["U0"][0, :WIDTH] = right / balance
    return w


def windows(ranks: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over texts laid end to end (each closed by END): inputs, targets, which targets count, and the text.

    Text i has the tokens ranks[starts[i] : starts[i + 1]]. A window takes WINDOW inputs; all but the first of a text
    begin OVERLAP tokens back, only for context, so that every token counts once. Windows end with their text.
    """
    lengths = np.diff(starts)
    step = WINDOW - OVERLAP
    n = np.where(lengths <= WINDOW, 1, 1 + -(-(lengths - WINDOW) // step))
    text = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    begin = k * step
    first = starts[:-1][text] + begin
    left = (lengths[text] - begin)[:, None]
    span = np.arange(WINDOW)
    inside = span < left
    padded = np.r_[END, ranks, np.full(WINDOW, END, ranks.dtype)]
    both = np.lib.stride_tricks.sliding_window_view(padded, WINDOW + 1)[first]
    inputs, targets = both[:, :-1].copy(), both[:, 1:]
    inputs[k == 0, 0] = END
    inputs[~inside] = END
    counts = inside & ((k == 0)[:, None] | (span >= OVERLAP))
    return inputs, targets, counts, text


def tree_place(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The head's output of each target; for those beyond the head (their rows): branch, twig, and place in the twig."""
    rest = targets.astype(np.int64) - HEAD
    rows = np.flatnonzero(rest >= 0)
    beyond = rest[rows]
    branch = beyond // FAN**2
    head = np.where(rest < 0, targets, 0)
    head[rows] = HEAD + branch
    return head, rows, branch, beyond // FAN, beyond % FAN


class Scorer:
    """The forward pass alone, with weights laid out so that few passes are made over few temporary arrays."""

    BATCH = 64

    def __init__(self, w: Weights) -> None:
        self.embed, self.place, self.hidden = w["E"], w["P"], (w["W1"], w["c1"], w["W2"])
        qkv = w["Wqkv"].copy()
        qkv[:, :WIDTH] *= np.float32(WIDTH**-0.5)
        qkv[:, 2 * WIDTH :] = qkv[:, 2 * WIDTH :] @ w["Wo"]
        self.qkv = qkv
        self.out = [w[f"U{i}"] for i in range(3)]

    def _hidden(self, inputs: np.ndarray) -> np.ndarray:
        n = len(inputs)
        x = self.embed[inputs]
        x += self.place
        x = x.reshape(-1, WIDTH)
        qkv = (x @ self.qkv).reshape(n, WINDOW, 3 * WIDTH)
        s = qkv[:, :, :WIDTH] @ qkv[:, :, WIDTH : 2 * WIDTH].transpose(0, 2, 1)
        if s.max() > 60:
            np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        s *= _SEEN
        v = np.ones((n, WINDOW, WIDTH + 1), np.float32)
        v[:, :, :WIDTH] = qkv[:, :, 2 * WIDTH :]
        z = (s @ v).reshape(-1, WIDTH + 1)
        x += z[:, :WIDTH] / z[:, WIDTH:]
        r = x @ self.hidden[0]
        r += self.hidden[1]
        np.maximum(r, 0, out=r)
        x += r @ self.hidden[2]
        return x

    def _softmax(self, level: int, node: int, h: np.ndarray, column: np.ndarray) -> np.ndarray:
        logits = h @ self.out[level][node]
        hit = logits[np.arange(len(logits)), column]
        if logits.max() > 80:
            top = logits.max(1, keepdims=True)
            logits -= top
            hit = hit - top[:, 0]
        np.exp(logits, out=logits)
        return hit - np.log(logits @ _ones(logits.shape[1]))

    def log10_probabilities(self, inputs: np.ndarray, targets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 P of each counted target, in the windows' order."""
        wanted, t = np.flatnonzero(counts), targets[counts]
        h = np.ones((len(t), WIDTH + 1), np.float32)
        ends = np.cumsum(counts.sum(1))
        head, rows, branch, twig, leaf = tree_place(t)
        total = np.empty(len(t))
        for at in range(0, len(inputs), self.BATCH):
            a, b = (ends[at - 1] if at else 0), ends[min(at + self.BATCH, len(inputs)) - 1]
            h[a:b, :WIDTH] = self._hidden(inputs[at : at + self.BATCH])[wanted[a:b] - at * WINDOW]
            for i in range(a, b, 1024):
                j = min(b, i + 1024)
                total[i:j] = self._softmax(0, 0, h[i:j], head[i:j])
        order = np.argsort(twig, kind="stable")
        rows, branch, twig, leaf = rows[order], branch[order], twig[order], leaf[order]
        h = h[rows]
        extra = np.empty(len(rows))
        for level, node, column in ((1, branch, twig % FAN), (2, twig, leaf)):
            cuts = np.flatnonzero(np.diff(node, prepend=-1, append=-1)) if len(node) else np.zeros(1, int)
            for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                for i in range(a, b, 4096):
                    j = min(b, i + 4096)
                    extra[i:j] = self._softmax(level, int(node[i]), h[i:j], column[i:j])
            total[rows] += extra
        return total * LOG10_E


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of a sorted array, and where the run of each begins and ends."""
    begin = np.flatnonzero(np.diff(sorted_.astype(np.int64), prepend=-1))
    return sorted_[begin], begin, np.r_[begin[1:], len(sorted_)]


def _softmax_gradient(u: np.ndarray, h: np.ndarray, column: np.ndarray, scale: np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of a softmax's weights and of its rows."""
    p = h @ u
    if p.max() > 60:
        np.minimum(p, 60, out=p)
    np.exp(p, out=p)
    p *= (scale / (p @ _ones(p.shape[1])))[:, None]
    p[np.arange(len(p)), column] -= scale
    return h.T @ p, p @ u.T


def _cut_runs(begin: np.ndarray, end: np.ndarray, most: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of rows that follow each other, cut into pieces of equally many rows: the row at each place (the one past all rows fills a run's last piece up), the run of each piece, each run's first piece."""
    size = 4
    while size < most and size * len(begin) < end[-1]:
        size *= 2
    n = -(-(end - begin) // size)
    first = np.cumsum(n) - n
    run = np.repeat(np.arange(len(n)), n)
    rows = (begin[run] + (np.arange(len(run)) - first[run]) * size)[:, None] + np.arange(size)
    rows[rows >= end[run][:, None]] = end[-1]
    return rows, run, first


def _sum_pieces(values: np.ndarray, run: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the pieces' values by run. Most runs have few pieces, and a whole piece is added at a time."""
    total, n = values[first], np.diff(np.r_[first, len(run)])
    for k in range(1, int(n.max())):
        longer = np.flatnonzero(n > k)
        total[longer] += values[first[longer] + k]
    return total


def _padded(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([rows, np.zeros((1, rows.shape[1]), rows.dtype)])


def _node_gradients(u: np.ndarray, h: np.ndarray, column: np.ndarray, nodes: np.ndarray, begin: np.ndarray, end: np.ndarray, scale: np.float32, back: np.ndarray) -> np.ndarray:
    """_softmax_gradient for many nodes, each with a run of rows, all pieces of runs at once: returns the nodes' gradients, adds to those of the rows."""
    rows, run, first = _cut_runs(begin, end)
    has = np.flatnonzero(rows.ravel() < len(h))  # in their order, as runs follow each other
    part, own = _padded(h)[rows], u[nodes[run]]
    p = part @ own
    if p.max() > 60:
        np.minimum(p, 60, out=p)
    np.exp(p, out=p)
    p *= (scale / (p @ _ones(p.shape[2])))[:, :, None]
    p.reshape(-1, u.shape[2])[has, column] -= scale
    back += (p @ own.transpose(0, 2, 1)).reshape(-1, h.shape[1])[has]
    return _sum_pieces(part.transpose(0, 2, 1) @ p, run, first)


class Adam:
    """Adam, with moments for the rows that a step touches only."""

    def __init__(self, w: Weights) -> None:
        self.w, self.first, self.second = w, {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
        self.steps = 0

    def step(self, g: dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]], rate: float) -> None:
        self.steps += 1
        rate *= min(1.0, self.steps / 10)
        a, b = np.float32(1 / (1 - 0.9**self.steps)), np.float32(1 / (1 - 0.99**self.steps))
        for k, d in g.items():
            rows, d = d if isinstance(d, tuple) else (slice(None), d)
            m, v = self.first[k][rows], self.second[k][rows]  # copies for numbered rows, else views
            change = d - m
            change *= np.float32(0.1)
            m += change
            np.multiply(d, d, out=change)
            change -= v
            change *= np.float32(0.01)
            v += change
            if not isinstance(rows, slice):
                self.first[k][rows], self.second[k][rows] = m, v
            np.sqrt(v, out=change)
            change += np.float32(1e-8) / np.sqrt(b)
            np.divide(m, change, out=change)
            change *= a * np.float32(rate) / np.sqrt(b)
            self.w[k][rows] -= change


def train(w: Weights, inputs: np.ndarray, targets: np.ndarray, counts: np.ndarray, rate: float, batch: int = 96, seed: int = 0) -> Weights:
    """One pass of Adam over the windows; the weights given stay as they are."""
    adam = Adam({k: v.copy() for k, v in w.items()})
    train_more(adam, inputs, targets, counts, rate, batch, seed)
    return adam.w


def train_more(adam: Adam, inputs: np.ndarray, targets: np.ndarray, counts: np.ndarray, rate: float, batch: int = 96, seed: int = 0) -> None:
    """One pass over further windows, which changes the weights of `adam`."""
    order = np.random.default_rng(seed).permutation(len(inputs))
    w = adam.w
    scale = np.float32(WIDTH**-0.5)
    for begin in range(0, len(order), batch):
        rows_ = order[begin : begin + batch]
        inp, cnt = inputs[rows_], counts[rows_]
        wanted = np.flatnonzero(cnt)
        t = targets[rows_].ravel()[wanted]
        n = len(inp)
        # forward
        x = (w["E"][inp] + w["P"]).reshape(-1, WIDTH)
        qkv = (x @ w["Wqkv"]).reshape(n, WINDOW, 3 * WIDTH)
        q, k, v = qkv[:, :, :WIDTH], qkv[:, :, WIDTH : 2 * WIDTH], qkv[:, :, 2 * WIDTH :]
        s = q @ k.transpose(0, 2, 1)
        s *= scale
        if s.max() > 60:
            np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        s *= _SEEN
        s *= (1 / (s.reshape(-1, WINDOW) @ _ones(WINDOW))).reshape(n, WINDOW, 1)
        z = (s @ v).reshape(-1, WIDTH)
        y = x + z @ w["Wo"]
        r = y @ w["W1"]
        r += w["c1"]
        np.maximum(r, 0, out=r)
        h = np.ones((len(wanted), WIDTH + 1), np.float32)
        out = r @ w["W2"]
        out += y
        h[:, :WIDTH] = out[wanted]
        # softmaxes
        even = np.float32(1 / len(t))
        head, rest, branch, twig, leaf = tree_place(t)
        own, dh_rows = _softmax_gradient(w["U0"][0], h, head, even)
        g: dict = {"U0": own[None]}
        if len(rest):
            order_ = np.argsort(twig, kind="stable")
            rest, branch, twig, leaf = rest[order_], branch[order_], twig[order_], leaf[order_]
            part, back = h[rest], np.zeros((len(rest), WIDTH + 1), np.float32)
            for name, node, column in (("U1", branch, twig % FAN), ("U2", twig, leaf)):
                nodes, *run = _runs(node)
                g[name] = (nodes, _node_gradients(w[name], part, column, nodes, *run, even, back))
            dh_rows[rest] += back
        # backward
        dh = np.zeros_like(y)
        dh[wanted] = dh_rows[:, :WIDTH]
        du = dh @ w["W2"].T
        du *= r > 0
        g["W2"], g["W1"], g["c1"] = r.T @ dh, y.T @ du, _ones(len(du)) @ du
        dy = dh + du @ w["W1"].T
        g["Wo"] = z.T @ dy
        dz = (dy @ w["Wo"].T).reshape(n, WINDOW, WIDTH)
        dqkv = np.empty((n, WINDOW, 3 * WIDTH), np.float32)
        dqkv[:, :, 2 * WIDTH :] = s.transpose(0, 2, 1) @ dz
        ds = dz @ v.transpose(0, 2, 1)
        ds -= np.einsum("ijk,ijk->ij", dz, z.reshape(n, WINDOW, WIDTH))[:, :, None]
        ds *= s
        ds *= scale
        dqkv[:, :, :WIDTH] = ds @ k
        dqkv[:, :, WIDTH : 2 * WIDTH] = ds.transpose(0, 2, 1) @ q
        dqkv = dqkv.reshape(-1, 3 * WIDTH)
        g["Wqkv"] = x.T @ dqkv
        dy += dqkv @ w["Wqkv"].T
        g["P"] = dy.reshape(n, WINDOW, WIDTH).sum(0)
        place = np.argsort(inp.ravel(), kind="stable")
        met, begin_, _ = _runs(inp.ravel()[place])
        g["E"] = (met, np.add.reduceat(dy[place], begin_, axis=0))
        adam.step(g, rate)


def flatten(w: Weights) -> np.ndarray:
    """All weights in rows of WIDTH."""
    flat = np.concatenate([w[k].ravel() for k in sorted(w)])
    return np.r_[flat, np.zeros(-len(flat) % WIDTH, np.float32)].reshape(-1, WIDTH)


def unflatten(rows: np.ndarray, like: Weights) -> Weights:
    out, at, flat = {}, 0, rows.ravel()
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def pack_changes(change: np.ndarray) -> bytes:
    """The rows that aren't zero: how many, their numbers, their values."""
    has = np.flatnonzero(change.any(1))
    return np.array([len(has)], "<i4").tobytes() + has.astype("<i4").tobytes() + change[has].astype("<f4").tobytes()


def add_changes(total: np.ndarray, packed: bytes, times: float) -> None:
    n = int(np.frombuffer(packed, "<i4", 1)[0])
    rows = np.frombuffer(packed, "<i4", n, 4)
    total[rows] += times * np.frombuffer(packed, "<f4", n * WIDTH, 4 + 4 * n).reshape(n, WIDTH)
