"""A character-level bidirectional LSTM with CRF transitions, trained and run in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

FORBIDDEN = np.float32(-1e4)


@dataclass
class Tagger:
    """Weights. `table[d]` holds each symbol's input to the four gates, `loop[d]` the recurrence, d = 0 forward."""

    table: np.ndarray  # (2, symbols, 4 H)
    loop: np.ndarray  # (2, H, 4 H)
    out: np.ndarray  # (2 H, tags)
    bias: np.ndarray  # (tags,)
    step: np.ndarray  # (tags, tags)
    allowed: np.ndarray = field(repr=False)  # (tags, tags) bool; tag 0 may always begin

    @property
    def names(self) -> list[str]:
        return ["table", "loop", "out", "bias", "step"]


def fresh(symbols: int, hidden: int, allowed: np.ndarray, seed: int = 11) -> Tagger:
    rng = np.random.Generator(np.random.PCG64(seed))
    k = len(allowed)
    table = rng.normal(0, 0.3, (2, symbols, 4 * hidden)).astype(np.float32)
    table[:, :, hidden : 2 * hidden] += 1.0  # forget gates start open
    loop = rng.normal(0, hidden**-0.5, (2, hidden, 4 * hidden)).astype(np.float32)
    out = rng.normal(0, 0.2, (2 * hidden, k)).astype(np.float32)
    return Tagger(table, loop, out, np.zeros(k, np.float32), np.zeros((k, k), np.float32), allowed)


def _scan(net: Tagger, d: int, ids: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states (T, B, H) of one direction; ids (T, B) in reading order of that direction."""
    t, b = ids.shape
    n = net.loop.shape[1]
    h, c = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
    states = np.empty((t, b, n), np.float32)
    for i in range(t):
        z = net.table[d][ids[i]]
        z += h @ net.loop[d]
        gates = z[:, : 3 * n]
        gates *= 0.5
        np.tanh(z, out=z)
        gates += 1
        gates *= 0.5
        before = c
        c = z[:, n : 2 * n] * c + z[:, :n] * z[:, 3 * n :]
        bent = np.tanh(c)
        if keep is not None:
            keep.append((z, before, bent, h))
        h = z[:, 2 * n : 3 * n] * bent
        states[i] = h
    return states


def emissions(net: Tagger, ids: np.ndarray) -> np.ndarray:
    """(T, B, tags) of symbol ids (T, B)."""
    both = np.concatenate([_scan(net, 0, ids, None), _scan(net, 1, ids[::-1], None)[::-1]], 2)
    return both @ net.out + net.bias


def _steps(net: Tagger) -> np.ndarray:
    return np.where(net.allowed, net.step, FORBIDDEN)


def _begin(net: Tagger) -> np.ndarray:
    return np.where(net.allowed[0], 0, FORBIDDEN).astype(np.float32)


def viterbi(net: Tagger, em: np.ndarray) -> np.ndarray:
    """The best tag path (T, B) under the CRF."""
    t, b, k = em.shape
    step = _steps(net)
    score, back = em[0] + _begin(net), np.empty((t, b, k), np.int8)
    for i in range(1, t):
        options = score[:, :, None] + step
        back[i] = options.argmax(1)
        score = options.max(1) + em[i]
    path = np.empty((t, b), np.int64)
    path[-1] = score.argmax(1)
    rows = np.arange(b)
    for i in range(t - 1, 0, -1):
        path[i - 1] = back[i][rows, path[i]]
    return path


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def loss_and_gradients(net: Tagger, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood of the tags (T, B) and its gradients."""
    t, b = ids.shape
    n, k = net.loop.shape[1], len(net.bias)
    kept: list[list] = [[], []]
    both = np.concatenate([_scan(net, 0, ids, kept[0]), _scan(net, 1, ids[::-1], kept[1])[::-1]], 2)
    em = both @ net.out + net.bias
    step, rows = _steps(net), np.arange(b)
    alpha, beta = np.empty_like(em), np.zeros_like(em)
    alpha[0] = em[0] + _begin(net)
    for i in range(1, t):
        alpha[i] = _lse(alpha[i - 1][:, :, None] + step, 1) + em[i]
    for i in range(t - 2, -1, -1):
        beta[i] = _lse(step + (em[i + 1] + beta[i + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    gold = em[0][rows, tags[0]] + sum(em[i][rows, tags[i]] + step[tags[i - 1], tags[i]] for i in range(1, t))
    d_em = np.exp(alpha + beta - z[:, None])
    d_step = np.zeros_like(net.step)
    for i in range(1, t):
        d_step += np.exp(alpha[i - 1][:, :, None] + step + (em[i] + beta[i])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(d_step, (tags[i - 1], tags[i]), -1)
    for i in range(t):
        d_em[i][rows, tags[i]] -= 1
    d_em, d_step = (d_em / b).astype(np.float32), np.where(net.allowed, d_step / b, 0).astype(np.float32)
    grads = {
        "out": both.reshape(-1, 2 * n).T @ d_em.reshape(-1, k), "bias": d_em.sum((0, 1)), "step": d_step,
        "table": np.zeros_like(net.table), "loop": np.zeros_like(net.loop),
    }
    d_both = d_em @ net.out.T
    for d in (0, 1):
        d_h_all = d_both[:, :, :n] if d == 0 else d_both[::-1, :, n:]
        order = ids if d == 0 else ids[::-1]
        dz_all = np.empty((t, b, 4 * n), np.float32)
        d_h, d_c = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
        for i in range(t - 1, -1, -1):
            g, before, bent, h = kept[d][i]
            i_, f, o, new = g[:, :n], g[:, n : 2 * n], g[:, 2 * n : 3 * n], g[:, 3 * n :]
            d_h = d_h + d_h_all[i]
            d_c = d_c + d_h * o * (1 - bent**2)
            dz = dz_all[i]
            dz[:, :n] = d_c * new * i_ * (1 - i_)
            dz[:, n : 2 * n] = d_c * before * f * (1 - f)
            dz[:, 2 * n : 3 * n] = d_h * bent * o * (1 - o)
            dz[:, 3 * n :] = d_c * i_ * (1 - new**2)
            grads["loop"][d] += h.T @ dz
            d_h, d_c = dz @ net.loop[d].T, d_c * f
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        seen, first = np.unique(flat[by], return_index=True)
        grads["table"][d][seen] = np.add.reduceat(dz_all.reshape(-1, 4 * n)[by], first)
    return float((z - gold).mean()), grads


def train(net: Tagger, ids: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 96, rate: float = 0.03, seed: int = 3) -> list[float]:
    """Adam over shuffled batches of the windows ids (N, T) with tags (N, T); changes net, returns each epoch's loss."""
    rng = np.random.Generator(np.random.PCG64(seed))
    m = {p: np.zeros_like(getattr(net, p)) for p in net.names}
    v = {p: np.zeros_like(getattr(net, p)) for p in net.names}
    losses, count, total = [], 0, epochs * -(-len(ids) // batch)
    for _ in range(epochs):
        order, seen = rng.permutation(len(ids)), []
        for at in range(0, len(ids), batch):
            pick = order[at : at + batch]
            loss, grads = loss_and_gradients(net, ids[pick].T, tags[pick].T)
            count += 1
            pace = rate * (1 - count / (total + 1))
            for p, g in grads.items():
                m[p] = 0.9 * m[p] + 0.1 * g
                v[p] = 0.99 * v[p] + 0.01 * g * g
                getattr(net, p)[...] -= pace * (m[p] / (1 - 0.9**count)) / (np.sqrt(v[p] / (1 - 0.99**count)) + 1e-7)
            seen.append(loss)
        losses.append(float(np.mean(seen)))
    return losses
