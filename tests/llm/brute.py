"""Plain versions of the operators, one text at a time."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SECRETS = (("assign", r"""(?a:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16))


def secrets(text):
    spans = [(m.start(), i, k, m.end()) for i, (k, p, g, n) in enumerate(SECRETS) for m in re.finditer(p, text or "") if len(m[g]) >= n]
    spans.sort()
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)


def line_dedup(docs, least=20, many=3):
    """[(id, text)] -> [(id, lines, dropped, kept)]."""
    keys = [(i, [(x, x.translate(LOW).strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]) for i, t in docs]
    holders = defaultdict(set)
    for i, lines in keys:
        for _, k in lines:
            if i is not None and len(k) >= least:
                holders[k].add(i)
    out = []
    for i, lines in keys:
        kept = [x for x, k in lines if i is None or len(holders[k]) < many or max(holders[k]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def quality_kept(text):
    """No rule rejects."""
    text = text or ""
    n, chars, symbols, _, repeats = quality(text)
    lines = Counter(x for x in text.split("\n") if WORD.search(x))
    letters = sum(any(c.isalpha() for c in w) for w in WORD.findall(text))
    return not (n < 20 or 100 * repeats > 30 * n or chars < 3 * n or chars > 10 * n or 100 * symbols > 10 * n
                or 100 * sum((k - 1) * len(x) for x, k in lines.items()) > 30 * len(text) or 100 * letters < 50 * n)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(docs, t=75):
    """[(id, text)] -> {id: (set size, smallest linked id)}."""
    sets = {i: shingles(x) for i, x in docs}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, s in sets.items():
        for b, n in Counter(j for x in s for j in by[x] if j < a).items():
            if 100 * n >= t * (len(s) + len(sets[b]) - n):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}
