"""Plain Python versions of what the operators compute, one document or pair at a time."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def blank_words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", ascii_lower(text)) if w]


def shingles(text, size):
    words = blank_words(text)
    if not words:
        return []
    return [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def fingerprint(text, size=3):
    import xxhash

    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles(text, size)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n, linked):
    """The least index reachable from each of n, by pairs for which ``linked`` holds."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def dedup_lines(docs, window=3):
    """{key: text} for [(key, text)] in order of first occurrence."""
    seen, out = set(), {}
    for key, text in docs:
        if text is None:
            out[key] = None
            continue
        lines = text.split("\n")
        full = [(i, line.strip(" \t\r")) for i, line in enumerate(lines) if line.strip(" \t\r")]
        gone = set()
        for k in range(len(full) - window + 1):
            key3 = tuple(line for _, line in full[k : k + window])
            if key3 in seen:
                gone |= set(range(full[k][0], full[k + window - 1][0] + 1))
            seen.add(key3)
        out[key] = "\n".join(line for i, line in enumerate(lines) if i not in gone)
    return out


def contamination(text, items, window=13):
    """(words, hit words, item ids) of a text against [(id, text)]."""
    words = WORD.findall(ascii_lower(text))
    hit, found = set(), set()
    for item, item_text in items:
        other = WORD.findall(ascii_lower(item_text))
        size = min(window, len(other))
        if not size:
            continue
        grams = {tuple(other[i : i + size]) for i in range(len(other) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(words), len(hit), found


def runs(text):
    """Runs of one to three characters in the words of a text."""
    found = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f" {word} "
        found.update(word)
        found.update(padded[i : i + 2] for i in range(len(padded) - 1))
        found.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return found


def code(run):
    value = 0
    for c in run:
        value = value << 21 | ord(c)
    return value


def top_runs(counts, size):
    return [r for _, _, r in sorted((-n, code(r), r) for r, n in counts.items())[:size]]


def language(text, profiles, size):
    """(language, score) by out-of-place distance."""
    top = top_runs(runs(text or ""), size)
    if not top:
        return "und", 0.0
    best = min(
        (sum(abs(i - ranks[r]) if r in ranks else size for i, r in enumerate(top)), lang) for lang, ranks in profiles.items()
    )
    return best[1], 1 - best[0] / (size * len(top))


def best_fit(lengths, capacities, cost):
    """The rule of the packing operator, by looking at every open bin, and at every piece to come."""
    sizes, bins = sorted(capacities), []
    for i, n in enumerate(lengths):
        fits = [b for b in bins if b[0] - b[1] >= n]
        if fits:
            chosen = min(fits, key=lambda b: (b[0] - b[1], bins.index(b)))
        else:

            def per_token(size):
                fill = n
                for m in lengths[i + 1 :]:  # longest first
                    fill += m if fill + m <= size else 0
                return cost(min(s for s in sizes if s >= fill)) / max(1, fill)

            chosen = [min((s for s in sizes if s >= n), key=per_token), 0, []]
            bins.append(chosen)
        chosen[2].append(n)
        chosen[1] += n
    return [(min(s for s in sizes if s >= b[1]), b[2]) for b in bins]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
