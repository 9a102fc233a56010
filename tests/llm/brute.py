"""Plain versions of what models learn and say, in loops over single values."""

import math
from collections import Counter
from zlib import crc32

import numpy as np

from nearfield.llm import quality_model as qm


def share(n, of):
    return n / of if of else 0.0


def statistics(text):
    b = (text or "").encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    words, word = [], b""
    for c in low:
        if c in b" \t\n\x0b\x0c\r":
            words, word = words + [word] if word else words, b""
        else:
            word += bytes([c])
    words += [word] if word else []
    n = max(1, len(words))
    letters = sum(65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in b)
    fours = [tuple(words[i : i + 4]) for i in range(len(words) - 3)]
    lines = [x for x in (line.strip(b" \t\n\x0b\x0c\r") for line in b.split(b"\n")) if len(x) >= 20]
    return len(words), {
        "symbols": sum(c in b"#*$%&|<>{}[]~^=\\" for c in b) / n,
        "marks": sum(c in b"!?" for c in b) / n,
        "letters": letters / max(1, sum(map(len, words))),
        "capitals": sum(65 <= c <= 90 for c in b) / max(1, letters),
        "repeats": sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / n,
        "phrases": share(len(fours) - len(set(fours)), len(fours)),
        "lines": share(len(lines) - len(set(lines)), len(lines)),
        "short_words": sum(len(w) == 1 for w in words) / n,
    }


def votes(text):
    n, s = statistics(text)
    out = []
    for name, below, low, above, high, needed in qm.LABELLERS:
        out.append(0 if n < needed else low if s[name] < below else high if s[name] >= above else 0)
    return tuple(out)


def clean_by_pattern(patterns, rounds=100):
    """Expectation-maximisation, one labeller and one pattern at a time."""
    at = {v: 0.1 if -1 in v else 0.95 for v in patterns}
    for _ in range(rounds):
        rates = {}
        for c, (junk0, clean0) in ((1, (0.5, 40.0)), (0, (20.0, 12.0))):
            for k in range(len(qm.LABELLERS)):
                junk = junk0 + sum(n * (at[v] if c else 1 - at[v]) for v, n in patterns.items() if v[k] == -1)
                clean = clean0 + sum(n * (at[v] if c else 1 - at[v]) for v, n in patterns.items() if v[k] == 1)
                wrong = junk / (junk + clean)
                rates[c, k] = min(wrong, qm.MOST_WRONG) if c else wrong
        total = sum(patterns.values())
        prior = {1: (sum(n * at[v] for v, n in patterns.items()) + 9) / (total + 10), 0: (sum(n * (1 - at[v]) for v, n in patterns.items()) + 1) / (total + 10)}
        after = {}
        for v in patterns:
            log = {c: math.log(prior[c]) + sum(math.log(rates[c, k] if x == -1 else 1 - rates[c, k]) for k, x in enumerate(v) if x) for c in (0, 1)}
            after[v] = 1 / (1 + math.exp(min(50, max(-50, log[0] - log[1]))))
        moved, at = max(abs(after[v] - at[v]) for v in at), after
        if moved < 1e-6:
            break
    return at


def feature_row(text):
    b = (text or "").encode()
    x = np.zeros(qm.FEATURES + 1)
    n, s = statistics(text)
    for name in [f"{k}:{min(20, int(20 * v + 0.5))}" for k, v in s.items()] + [f"words:{n.bit_length()}"]:
        x[qm.TRIGRAMS + crc32(name.encode()) % (qm.FEATURES - qm.TRIGRAMS)] += 1
    for i in range(len(b) - 2):
        h = (b[i] * 0x9E3779B1 % 2**32) ^ (b[i + 1] * 0x85EBCA77 % 2**32) ^ (b[i + 2] * 0xC2B2AE3D % 2**32)
        x[(h >> 15) % qm.TRIGRAMS] += qm.TRIGRAM_SCALE / (len(b) - 2)
    x[qm.FEATURES] = 1
    return x


def quality_scores(texts):
    """Of texts that all are in the sample, in double precision."""
    patterns = Counter(map(votes, texts))
    clean = clean_by_pattern(patterns)
    x, y = np.array([feature_row(t) for t in texts]), np.array([clean[votes(t)] for t in texts])
    good = int((y > 0.5).sum())
    share_of = np.array([0.5 / max(1, good) if p > 0.5 else 0.5 / max(1, len(y) - good) for p in y])
    share_of /= share_of.sum()
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, 301):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = sum(share_of[i] * (p[i] - y[i]) * x[i] for i in range(len(y))) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def states(net, window, d):
    """The state after each byte of a window, one unit at a time."""
    n, e, u, b = net.hidden, net.p[f"e{d}"].astype(float), net.p[f"u{d}"].astype(float), net.p[f"b{d}"].astype(float)
    h, out = [0.0] * n, {}
    for t in range(len(window)) if d == "f" else reversed(range(len(window))):
        c = window[t]
        s = [sum(u[i][j] * h[j] for j in range(n)) for i in range(3 * n)]
        z = [sigmoid(e[i][c] + s[i]) for i in range(n)]
        r = [sigmoid(e[n + i][c] + s[n + i]) for i in range(n)]
        new = [math.tanh(e[2 * n + i][c] + r[i] * (s[2 * n + i] + b[i][0])) for i in range(n)]
        h = [h[i] + z[i] * (new[i] - h[i]) for i in range(n)]
        out[t] = h
    return out


def language_probabilities(net, text, window, fill):
    """The mean over all bytes of the text."""
    total = [0.0] * len(net.languages)
    for lo in range(0, len(text), window):
        some = list(text[lo : lo + window])
        padded = some + [fill] * (window - len(some))
        f, b = states(net, padded, "f"), states(net, padded, "b")
        for t in range(len(some)):
            both = f[t] + b[t]
            logit = [float(net.p["c"][k][0]) + sum(float(net.p["v"][k][i]) * x for i, x in enumerate(both)) for k in range(len(total))]
            top = max(logit)
            odds = [math.exp(x - top) for x in logit]
            total = [a + o / sum(odds) for a, o in zip(total, odds)]
    return [x / len(text) for x in total]
