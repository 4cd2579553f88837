"""Plain single-process versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def roots(n: int, pairs) -> list[int]:
    """Smallest member of each element's set."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def fingerprint(text: str | None) -> int:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_groups(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(doc_id, fingerprint, component_id) of each row."""
    prints = [fingerprint(t) for _, t in rows]
    n = len(rows)
    near = [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = roots(n, near)
    least = {}
    for r, (i, _) in zip(root, rows):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, root)]


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def removed_lines(rows, normalised, takes_part, simhashes) -> list[set[int]]:
    """Numbers of the lines that go, for each row (ids are distinct)."""
    seen = []
    for at, (doc, text) in enumerate(rows):
        for nth, line in enumerate(normalised(text or "").split("\n")):
            if takes_part(line):
                seen.append((line, (doc is None, doc or 0, nth), at))
    lines = sorted({s[0] for s in seen})
    prints = [int(p) for p in simhashes(lines)] if lines else []
    near = [
        (i, j) for i in range(len(lines)) for j in range(i)
        if (prints[i] ^ prints[j]).bit_count() <= 3
        and min(len(lines[i]), len(lines[j])) >= 0.8 * max(len(lines[i]), len(lines[j]))  # else surely apart
        and 1 - levenshtein(lines[i], lines[j]) / max(len(lines[i]), len(lines[j])) >= 0.8 - 1e-12
    ]
    root = dict(zip(lines, roots(len(lines), near)))
    first = {}
    for line, place, _ in sorted(seen, key=lambda s: s[1]):
        first.setdefault(root[line], place)
    gone = [set() for _ in rows]
    for line, place, at in seen:
        if first[root[line]] != place:
            gone[at].add(place[2])
    return gone


def repeats(rows: list[tuple[int | None, str | None]], window: int = 50) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    first: dict[tuple, int] = {}
    texts = [WORD.findall(t or "") for _, t in rows]
    for (doc, _), words in zip(rows, texts):
        for k in range(len(words) - window + 1) if doc is not None else ():
            w = tuple(words[k : k + window])
            first[w] = min(doc, first.get(w, doc))
    out = []
    for (doc, _), words in zip(rows, texts):
        gone = set()
        for k in range(len(words) - window + 1) if doc is not None else ():
            if first[tuple(words[k : k + window])] < doc:
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def smith_waterman(a: list, b: list, match=2, mismatch=-1, gap=-1) -> int:
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch),
                          h[i - 1][j] + gap, h[i][j - 1] + gap)
    return max(map(max, h))


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(text: str) -> bool:
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(text))) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
]


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    return [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, text or "") if ok(m[0])]
