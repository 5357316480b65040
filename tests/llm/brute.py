"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\v\f\r"
SECRETS = (
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(docs: list[tuple[int, str | None]], min_chars: int = 20, min_docs: int = 3) -> list[tuple]:
    key = lambda line: line.strip(BLANK).translate(LOWER)
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or doc == max(holders[key(x)])]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out)


def shingles(text: str | None, n: int = 4) -> set:
    words = WORD.findall((text or "").translate(LOWER))
    return set(zip(*[words[i:] for i in range(n)])) if len(words) >= n else {tuple(words)} if words else set()


def jaccard_components(docs: list[tuple[int, str | None]], percent: int = 85) -> dict[int, int]:
    sets = [(d, shingles(t)) for d, t in docs]
    label = {d: d for d, _ in docs}

    def top(d: int) -> int:
        while label[d] != d:
            d = label[d]
        return d

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((top(a), top(b)))
            label[b] = a
    return {d: top(d) for d, _ in docs}


def quality_base(text: str | None) -> tuple:
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def secret_spans(text: str | None) -> list[tuple[int, int, int]]:
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(SECRETS) for m in p.finditer(text or "") if ok(m))


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{SECRETS[k][0]}:{a}:{b}" for a, k, b in spans)


def redact(text: str | None, mask: str = "[secret]") -> str | None:
    at, out = 0, []
    for a, _, b in secret_spans(text):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def top_k(vectors: list[tuple], k: int = 5, scale: int = 256) -> list[tuple]:
    import math

    items = defaultdict(list)
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            items[i].append([math.floor(scale * x) for x in v])
    out = []
    for q in items:
        if q % 50 == 0:
            near = []
            for c in items:
                scores = [sum(x * y for x, y in zip(a, b)) for a in items[q] for b in items[c] if c != q and len(a) == len(b)]
                if scores:
                    near.append((-max(scores), c))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(near)[:k])]
    return sorted(out)
