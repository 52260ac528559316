"""Plain versions of the operators' definitions, one document after the other."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingles(text, width):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return frozenset()
    n = min(width, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def classes(docs, width, percent):
    """Smallest reachable id of every id."""
    sets = {}
    for i, text in docs:
        sets.setdefault(i, []).append(shingles(text, width))
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    flat = [(i, s) for i, group in sets.items() for s in group if s]
    for k, (i, a) in enumerate(flat):
        for j, b in flat[:k]:
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def without_shared(docs, width, split, join):
    """id -> (units, removed, sha256 of what is kept) for distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        units = split((text or "").encode())
        own = [tuple(units[k : k + width]) for k in range(len(units) - width + 1)]
        gone = {k + j for k, g in enumerate(own) if g in seen for j in range(width)}
        seen.update(own)
        kept = join([units[k : k + 1] if isinstance(units, bytes) else units[k] for k in range(len(units)) if k not in gone])
        out[i] = (len(units), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def rule_counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    again = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def identifiers(text):
    out = []
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]
    for rank, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m.group() if c.isdigit() and c.isascii()]
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            if kind == "card":
                total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))
