"""A character-level bidirectional LSTM with CRF transitions, in numpy, trained from labelled spans."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: The base patterns find the first four; secrets are the tagger's alone.
KINDS = ("email", "ip", "card", "phone", "secret")
#: 0 is outside; 1 + 2 * kind begins a span and 2 + 2 * kind goes on with it.
TAGS = 1 + 2 * len(KINDS)
CHARS, DIM, HIDDEN = 98, 10, 20
STEPS, BATCH, LENGTH, RATE = 600, 48, 112, 0.012


def encode(text: str) -> np.ndarray:
    """Printable ASCII as 1 to 95, other letters as 96 and all else as 97; 0 pads."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.where((cp >= 32) & (cp < 127), cp - 31, np.where(cp >= 0xC0, 96, 97))
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Weights and the passes through them. Sequences of a batch are padded on the right; pads change nothing."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        w = lambda *shape, s=0.25: r.normal(0, s, shape).astype(np.float32)
        self.p = {"emb": w(CHARS, DIM, s=0.5), "out": w(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": w(DIM, 4 * HIDDEN), f"h{d}": w(HIDDEN, 4 * HIDDEN), f"b{d}": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)}

    def _run(self, x, mask, d, keep):
        """States (T, N, H) of one direction; x is (T, N) and comes in the order of the direction."""
        p, (t_all, n) = self.p, x.shape
        inputs = p["emb"] @ p[f"x{d}"] + p[f"b{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.empty((t_all, n, HIDDEN), np.float32)
        saved = []
        for t in range(t_all):
            z = inputs[x[t]] + h @ p[f"h{d}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            before_h, before_c = h, c
            c = (f * c + i * g) * m
            tc = np.tanh(c)
            h = o * tc * m
            out[t] = h
            if keep:
                saved.append((i, f, o, g, before_h, before_c, tc, m))
        return out, saved

    def _back(self, x, d_out, d, saved, grads):
        p = self.p
        dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        d_in = np.zeros((CHARS, 4 * HIDDEN), np.float32)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g, before_h, before_c, tc, m = saved[t]
            dh = (dh + d_out[t]) * m
            dc = (dc + dh * o * (1 - tc * tc)) * m
            dz = np.concatenate([dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            np.add.at(d_in, x[t], dz)
            grads[f"h{d}"] += before_h.T @ dz
            dh, dc = dz @ p[f"h{d}"].T, dc * f
        grads[f"b{d}"] += d_in.sum(axis=0)
        grads[f"x{d}"] += p["emb"].T @ d_in
        grads["emb"] += d_in @ p[f"x{d}"].T

    def emissions(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """(T, N, TAGS) for x (N, T)."""
        xt = x.T
        mask = (np.arange(len(xt))[:, None] < lengths).astype(np.float32)
        fwd, sf = self._run(xt, mask, "f", keep)
        bwd, sb = self._run(xt[::-1], mask[::-1], "b", keep)
        states = np.concatenate([fwd, bwd[::-1]], axis=2)
        e = states @ self.p["out"] + self.p["bias"]
        return (e, states, mask, sf, sb) if keep else e

    def loss_grads(self, x, lengths, tags):
        p = self.p
        e, states, mask, sf, sb = self.emissions(x, lengths, True)
        (t_all, n, _), tt = e.shape, tags.T
        alpha = np.empty_like(e)
        alpha[0] = e[0] + p["first"]
        for t in range(1, t_all):
            s = alpha[t - 1][:, :, None] + p["trans"]
            top = s.max(axis=1)
            step = top + np.log(np.exp(s - top[:, None]).sum(axis=1)) + e[t]
            alpha[t] = np.where(mask[t][:, None] > 0, step, alpha[t - 1])
        last = alpha[-1]
        top = last.max(axis=1, keepdims=True)
        z = (top + np.log(np.exp(last - top).sum(axis=1, keepdims=True)))[:, 0]
        beta = np.zeros_like(e)
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        d_e = np.zeros_like(e)
        for t in range(t_all - 1, -1, -1):
            if t < t_all - 1:
                s = p["trans"] + (e[t + 1] + beta[t + 1])[:, None]
                top = s.max(axis=2)
                step = top + np.log(np.exp(s - top[:, :, None]).sum(axis=2))
                on = mask[t + 1][:, None] > 0
                beta[t] = np.where(on, step, 0)
                pair = np.exp(alpha[t][:, :, None] + s - z[:, None, None]) * on[:, :, None]
                grads["trans"] += pair.sum(axis=0)
                k = np.flatnonzero(mask[t + 1])
                np.add.at(grads["trans"], (tt[t, k], tt[t + 1, k]), -1)
            d_e[t] = np.exp(alpha[t] + beta[t] - z[:, None]) * mask[t][:, None]
        rows = np.arange(n)
        score = (p["first"][tt[0]] + e[0, rows, tt[0]]).copy()
        for t in range(t_all):
            d_e[t, rows, tt[t]] -= mask[t]
            if t:
                score += (p["trans"][tt[t - 1], tt[t]] + e[t, rows, tt[t]]) * mask[t]
        grads["first"] += d_e[0].sum(axis=0)
        grads["out"] += np.einsum("tnh,tnk->hk", states, d_e)
        grads["bias"] += d_e.sum(axis=(0, 1))
        d_states = d_e @ p["out"].T
        self._back(x.T, d_states[:, :, :HIDDEN], "f", sf, grads)
        self._back(x.T[::-1], d_states[::-1, :, HIDDEN:], "b", sb, grads)
        return float((z - score).sum()), {k: g / n for k, g in grads.items()}

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best tags (N, T) under emissions and transitions; spans go on only with their own kind."""
        e = self.emissions(x, lengths)
        t_all, n, _ = e.shape
        trans, first = self.p["trans"].copy(), self.p["first"].copy()
        for k in range(len(KINDS)):
            bad = [t for t in range(TAGS) if t not in (1 + 2 * k, 2 + 2 * k)]
            trans[bad, 2 + 2 * k] = -1e4
            first[2 + 2 * k] = -1e4
        best, back = e[0] + first, np.zeros((t_all, n, TAGS), np.int8)
        for t in range(1, t_all):
            s = best[:, :, None] + trans
            step = s.max(axis=1) + e[t]
            on = (t < lengths)[:, None]
            back[t] = np.where(on, s.argmax(axis=1), np.arange(TAGS))
            best = np.where(on, step, best)
        out = np.zeros((n, t_all), np.int8)
        now = best.argmax(axis=1)
        for t in range(t_all - 1, -1, -1):
            out[:, t] = now
            now = back[t][np.arange(n), now]
        return np.where(np.arange(t_all) < lengths[:, None], out, 0)


def labelled_spans(rng: np.random.Generator, n: int, contexts: tuple[str, ...] = ()) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """n sentences with (kind, start, end) of the made-up personal data planted in them, and look-alikes that are none.

    The words around them are cut from the contexts, or made up where there are none.
    """
    d = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    pick = lambda xs: xs[rng.integers(len(xs))]
    word = lambda: "".join(pick(["en", "th", "er", "ti", "ra", "lo", "que", "sch", "é", "ción", "ou", "ha"]) for _ in range(rng.integers(1, 4)))

    def around(least: int, most: int) -> str:
        k = int(rng.integers(least, most))
        if contexts and rng.random() < 0.8:
            ws = pick(contexts).split()
            at = int(rng.integers(0, max(len(ws) - k, 0) + 1))
            return " ".join(ws[at : at + k])
        return " ".join(word() for _ in range(k))

    code = lambda signs, k: "".join(pick(list(signs)) for _ in range(k))
    upper, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef"

    def secret() -> tuple[str, str, str]:
        """What stands before a secret, the secret and what closes it."""
        if rng.random() < 0.45:
            mark = pick(["AKIA", "AKIA", "AKIA", "ASIA", "sk_live_", "sk_", "ghp_", "xoxb-"])
            return "", mark + code(upper if mark.isalpha() else upper + hexa * 2, 16 if mark.isalpha() else int(rng.integers(18, 36))), ""
        name = pick(["password", "token", "secret", "api_key", "apikey", "passwd", "access_token", "pwd", "key"])
        sign = pick(["=", "=", " = ", " = ", ": ", ":"])
        quote = pick(["", "", '"', '"', "'"])
        signs = pick([hexa, hexa, hexa, hexa.upper(), upper + hexa])
        value = code(signs, pick([16, 18, 20, 24, 32, 40, 40, int(rng.integers(10, 65))]))
        return f"{name}{sign}{quote}", value if any(c.isdigit() for c in value) else value + d(2), quote

    def card() -> str:
        digits = pick(["4", "5", "37", "6011"]) + d(20)
        digits = digits[: pick([15, 15, 14, 13, 16]) ]
        total = sum(int(c) if i % 2 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(digits)))
        digits += str(-total % 10)
        sep = pick(["", " ", "-", "."])
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    makers = {
        0: lambda: f"{word()}{pick(['.', '_', '', d(2)])}{word()}{pick(['@', '@', '@', ' @ ', '@ '])}{word()}{pick(['.com', '.org', '.net', '.co.uk', '.example.com', '.de'])}",
        1: lambda: pick([".", ".", ".", " . "]).join(str(rng.integers(1, 256)) for _ in range(4)),
        2: card,
        3: lambda: pick([lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"+{d(2)} {d(3)} {d(3)} {d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"00{d(2)} {d(3)} {d(7)}", lambda: f"+{d(11)}", lambda: f"{d(3)}.{d(3)}.{d(4)}"])(),
    }
    others = [lambda: f"20{d(2)}-0{rng.integers(1, 10)}-{rng.integers(10, 29)}", lambda: f"{rng.integers(1, 9)}.{rng.integers(0, 9)}", lambda: f"v{d(1)}.{d(1)}.{d(2)}", lambda: f"{d(1)},{d(3)}", lambda: d(int(rng.integers(1, 7))), lambda: f"${d(2)}.{d(2)}", lambda: f"@{word()}", lambda: f"{d(2)}:{d(2)}", lambda: "".join(pick(list("0123456789abcdef")) for _ in range(rng.integers(6, 16))), lambda: f"{word()}{d(3)}", lambda: f"version {d(1)}.", lambda: f"Version {d(1)}.{d(1)}.", lambda: f"License, {d(1)}.{d(1)}", lambda: f"{d(4)}-{d(4)}", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"CC BY-NC {d(1)}.0"]
    out = []
    for _ in range(n):
        text, spans = around(0, 6), []
        for _ in range(rng.integers(1, 4)):
            text += pick([" ", ", ", ": ", "\n", " ("]) if text else ""
            if rng.random() < 0.55:
                kind = int(rng.integers(len(KINDS)))
                before, value, after = ("", makers[kind](), "") if kind < 4 else secret()
                text += before
                spans.append((kind, len(text), len(text) + len(value)))
                text += value + after
            else:
                text += pick(others)()
            text += pick(["", ".", ",", ")"]) + " " + around(1, 5)
        out.append((text, spans))
    return out


def batch_of(examples, length: int):
    x, tags = np.zeros((len(examples), length), np.int64), np.zeros((len(examples), length), np.int64)
    lengths = np.zeros(len(examples), np.int64)
    for r, (text, spans) in enumerate(examples):
        lengths[r] = min(len(text), length)
        x[r, : lengths[r]] = encode(text)[:length]
        for kind, a, b in spans:
            tags[r, a:b] = 2 + 2 * kind
            if a < length:
                tags[r, a] = 1 + 2 * kind
    return x, lengths, tags


@lru_cache(maxsize=2)
def trained(seed: int = 3, steps: int = STEPS, contexts: tuple[str, ...] = ()) -> Tagger:
    """A tagger trained with Adam on labelled_spans among the contexts; the same arguments give the same weights."""
    model, rng = Tagger(seed), np.random.default_rng(seed)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    for step in range(1, steps + 1):
        x, lengths, tags = batch_of(labelled_spans(rng, BATCH, contexts), LENGTH)
        _, grads = model.loss_grads(x, lengths, tags)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g * min(1.0, 5 / (norm + 1e-9))
            m, v = state[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            model.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model
