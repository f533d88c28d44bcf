"""A character-level bidirectional LSTM with CRF transitions in numpy: forward, Viterbi and training."""

from __future__ import annotations

import numpy as np

#: One symbol per printable ASCII character; the rest by class.
_ASCII = {chr(c): c - 30 for c in range(32, 127)}
SYMBOLS = 104


def symbol(ch: str) -> int:
    """Number of a character: 0 is padding, 1 a line break, 2..96 ASCII, then classes of other characters."""
    if ch in _ASCII:
        return _ASCII[ch]
    if ch in "\n\r ":
        return 1
    code = ord(ch)
    if ch in "\t\xa0  　":
        return 97
    if ch == "＠":
        return 98
    if ch.isdigit():
        return 99
    if 0x900 <= code < 0x980:
        return 100
    if ch in "–—‐‑−":
        return 101
    if ch.isalpha():
        return 102
    return 103


_TABLE = np.array([symbol(chr(c)) for c in range(0x3100)], "u1")


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "u4")
    out = np.full(len(codes), 103, "u1")
    low = codes < len(_TABLE)
    out[low] = _TABLE[codes[low]]
    if not low.all():
        out[~low] = [symbol(chr(c)) for c in codes[~low]]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def new_weights(tags: int, embed: int = 16, hidden: int = 32, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {"E": rng.normal(0, 0.3, (SYMBOLS, embed))}
    for d in "fb":
        w[f"W{d}"] = rng.normal(0, 1 / np.sqrt(embed + hidden), (embed + hidden, 4 * hidden))
        bias = np.zeros(4 * hidden)
        bias[hidden : 2 * hidden] = 1
        w[f"c{d}"] = bias
    w |= {"O": rng.normal(0, 0.2, (2 * hidden, tags)), "o": np.zeros(tags), "T": rng.normal(0, 0.1, (tags, tags)), "S": np.zeros(tags)}
    return {k: v.astype("f4") for k, v in w.items()}


def _lstm(x: np.ndarray, w: np.ndarray, bias: np.ndarray, keep: bool):
    """x: (time, batch, embed). Gates in the order input, forget, cell, output."""
    n, batch, embed = x.shape
    h = w.shape[1] // 4
    drive = (x.reshape(-1, embed) @ w[:embed] + bias).reshape(n, batch, 4 * h)
    recur = np.ascontiguousarray(w[embed:])
    out, state, last = np.empty((n, batch, h), "f4"), np.zeros((batch, h), "f4"), np.zeros((batch, h), "f4")
    kept = []
    for t in range(n):
        z = drive[t] + last @ recur
        gates = _sigmoid(z)
        g = np.tanh(z[:, 2 * h : 3 * h])
        before, state = state, gates[:, h : 2 * h] * state + gates[:, :h] * g
        squashed = np.tanh(state)
        previous, last = last, gates[:, 3 * h :] * squashed
        out[t] = last
        if keep:
            kept.append((gates, g, before, squashed, previous))
    return out, kept


def _read_through(weights: dict[str, np.ndarray], d: str, symbols: np.ndarray) -> np.ndarray:
    """Hidden states without what training keeps. A sigmoid is half a tanh, so with halved weights one tanh serves all gates."""
    w, embed = weights[f"W{d}"], weights["E"].shape[1]
    h = w.shape[1] // 4
    half = np.full(4 * h, 0.5, "f4")
    half[2 * h : 3 * h] = 1
    drive = ((weights["E"] @ w[:embed] + weights[f"c{d}"]) * half).astype("f4")
    recur = np.ascontiguousarray(w[embed:] * half)
    n, batch = symbols.shape
    out = np.empty((n, batch, h), "f4")
    state, z, room = np.zeros((batch, h), "f4"), np.empty((batch, 4 * h), "f4"), np.empty((batch, h), "f4")
    last = np.zeros((batch, h), "f4")
    for t in range(n):
        np.matmul(last, recur, out=z)
        z += drive[symbols[t]]
        np.tanh(z, out=z)
        z[:, : 2 * h] += 1
        z[:, 3 * h :] += 1
        state *= z[:, h : 2 * h]
        np.multiply(z[:, :h], z[:, 2 * h : 3 * h], out=room)
        state += room
        state *= 0.5
        np.tanh(state, out=room)
        room *= z[:, 3 * h :]
        np.multiply(room, 0.5, out=out[t])
        last = out[t]
    return out


def scores(weights: dict[str, np.ndarray], symbols: np.ndarray) -> np.ndarray:
    """Tag scores (time, batch, tags) of symbols (time, batch)."""
    forward, backward = _read_through(weights, "f", symbols), _read_through(weights, "b", symbols[::-1])
    h = forward.shape[2]
    return forward @ weights["O"][:h] + backward[::-1] @ weights["O"][h:] + weights["o"]


def viterbi(weights: dict[str, np.ndarray], emit: np.ndarray) -> np.ndarray:
    """Best tags (time, batch)."""
    n, batch, tags = emit.shape
    into = np.ascontiguousarray(weights["T"].T)
    best = emit[0] + weights["S"]
    back = np.empty((n, batch, tags), "i1")
    rows, columns = np.arange(batch)[:, None], np.arange(tags)[None]
    for t in range(1, n):
        paths = best[:, None, :] + into
        back[t] = paths.argmax(2)
        best = paths[rows, columns, back[t]] + emit[t]
    out = np.empty((n, batch), "i1")
    out[-1] = best.argmax(1)
    rows = np.arange(batch)
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, rows, out[t]]
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def gradients(weights: dict[str, np.ndarray], symbols: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log likelihood per character and its gradients; symbols and tags are (time, batch)."""
    n, batch = symbols.shape
    x = weights["E"][symbols]
    forward, keep_f = _lstm(x, weights["Wf"], weights["cf"], True)
    backward, keep_b = _lstm(x[::-1], weights["Wb"], weights["cb"], True)
    hidden = np.concatenate([forward, backward[::-1]], 2)
    emit = hidden @ weights["O"] + weights["o"]
    step, k = weights["T"], emit.shape[2]
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[0] = emit[0] + weights["S"]
    for t in range(1, n):
        alpha[t] = _logsum(alpha[t - 1][:, :, None] + step, 1) + emit[t]
    for t in range(n - 2, -1, -1):
        beta[t] = _logsum(step[None] + (beta[t + 1] + emit[t + 1])[:, None, :], 2)
    whole = _logsum(alpha[-1], 1)
    rows = np.arange(batch)
    gold = (weights["S"][tags[0]] + emit[0, rows, tags[0]]).astype("f8")
    d_step = np.zeros_like(step)
    for t in range(1, n):
        gold += step[tags[t - 1], tags[t]] + emit[t, rows, tags[t]]
        pair = np.exp(alpha[t - 1][:, :, None] + step + (emit[t] + beta[t])[:, None, :] - whole[:, None, None])
        d_step += pair.sum(0)
        np.add.at(d_step, (tags[t - 1], tags[t]), -1)
    d_emit = np.exp(alpha + beta - whole[None, :, None])
    d_start = d_emit[0].sum(0) - np.bincount(tags[0], minlength=k)
    np.add.at(d_emit, (np.arange(n)[:, None], rows[None], tags), -1)
    scale = np.float32(1 / (n * batch))
    grads = {"T": d_step * scale, "S": d_start * scale, "o": d_emit.sum((0, 1)) * scale, "O": hidden.reshape(n * batch, -1).T @ d_emit.reshape(n * batch, -1) * scale}
    d_hidden = d_emit @ weights["O"].T * scale
    h = forward.shape[2]
    d_x = np.zeros_like(x)
    for d, kept, seq, d_out in (("f", keep_f, x, d_hidden[:, :, :h]), ("b", keep_b, x[::-1], d_hidden[::-1, :, h:])):
        w = weights[f"W{d}"]
        embed = x.shape[2]
        d_z = np.empty((n, batch, 4 * h), "f4")
        d_last, d_state = np.zeros((batch, h), "f4"), np.zeros((batch, h), "f4")
        recur = w[embed:].T
        for t in range(n - 1, -1, -1):
            gates, g, before, squashed, _ = kept[t]
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 3 * h :]
            d_h = d_out[t] + d_last
            d_c = d_state + d_h * o * (1 - squashed**2)
            z = d_z[t]
            z[:, :h] = d_c * g * i * (1 - i)
            z[:, h : 2 * h] = d_c * before * f * (1 - f)
            z[:, 2 * h : 3 * h] = d_c * i * (1 - g**2)
            z[:, 3 * h :] = d_h * squashed * o * (1 - o)
            d_state = d_c * f
            d_last = z @ recur
        flat = d_z.reshape(n * batch, -1)
        previous = np.stack([k_[4] for k_ in kept]).reshape(n * batch, -1)
        grads[f"W{d}"] = np.concatenate([seq.reshape(n * batch, -1).T @ flat, previous.T @ flat])
        grads[f"c{d}"] = flat.sum(0)
        back = (flat @ w[:embed].T).reshape(x.shape)
        d_x += back if d == "f" else back[::-1]
    grads["E"] = np.zeros_like(weights["E"])
    np.add.at(grads["E"], symbols, d_x)
    return float((whole - gold).sum() * scale), grads


def train(windows: np.ndarray, tags: np.ndarray, n_tags: int, epochs: int, batch: int = 128, rate: float = 4e-3, seed: int = 5, said=None, start: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Adam with a falling rate; windows and tags are (rows, time)."""
    weights, rng = start or new_weights(n_tags), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    steps, total = 0, epochs * (len(windows) // batch)
    for epoch in range(epochs):
        order, loss = rng.permutation(len(windows)), 0.0
        for at in range(0, len(order) - batch + 1, batch):
            pick = order[at : at + batch]
            cost, grads = gradients(weights, windows[pick].T, tags[pick].T)
            loss, steps = loss + cost, steps + 1
            size = np.sqrt(sum(float((g.astype("f8") ** 2).sum()) for g in grads.values()))
            now = rate * min(1.0, steps / 50) * (1 - 0.95 * steps / (total + 1))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = (weights[k] - now * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)).astype("f4")
        if said:
            said(f"epoch {epoch}: {loss / max(1, len(order) // batch):.5f}")
    return weights
