"""Plain Python versions of the contracts, one text at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter

UPPER = {c: c + 32 for c in range(65, 91)}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def contamination(docs, items, window=10):
    wins = {}
    for item_id, text in items:
        w = alnum_words(text)
        if item_id is not None and w:
            for s in range(max(len(w) - window, 0) + 1):
                wins.setdefault(tuple(w[s:s + window]), set()).add(str(item_id))
    lens = {len(k) for k in wins}
    out = {}
    for doc_id, text in docs:
        w = alnum_words(text)
        hit, ids = set(), set()
        for n in lens:
            for s in range(len(w) - n + 1):
                got = wins.get(tuple(w[s:s + n]))
                if got:
                    hit.update(range(s, s + n))
                    ids |= got
        out[doc_id] = (len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit))
    return out


def quality(text):
    w = space_words(text)
    seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    rep = set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i:i + 5])] > 1:
            rep.update(range(i, i + 5))
    lines = [s for s in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(rep),
            n < 10 or 100 * len(rep) > 20 * n)


def tokens(text):
    return space_words((text or "").translate(UPPER)) + ["\n"]


def unigram(docs):
    counts = Counter(t for d, x in docs if crc(d) % 7 != 2 for t in tokens(x))
    total, v = sum(counts.values()), len(counts)
    return {d: (crc(d) % 7 == 2, len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), total,
                sum(math.log10((counts[t] + 1) / (total + v + 1)) for t in tokens(x))) for d, x in docs}


ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def joined(spans, kinds):
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], kinds.index(x[2]))))


def secret_spans(text):
    t = text or ""
    return ([(m.start(), m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
            + [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
            + [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32])


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal_spans(text):
    t = text or ""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [(m.start(), m.end(), "email")
           for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(re.fullmatch("0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])", x) for x in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
            if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 10 <= len(digits(m[0])) <= 15]
    return out


def shingles(text, size=5):
    w = alnum_words(text)
    return frozenset(tuple(w[k:k + size]) for k in range(max(len(w) - size + 1, 1))) if w else frozenset()


def jaccard(docs, threshold=0.8):
    """doc_id -> (links, smallest id of the class, shingles), by all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    found, holders = Counter(), {}
    for i, s in sets.items():
        for t in s:
            holders.setdefault(t, []).append(i)
    for ids in holders.values():
        found.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1:])
    links, root = Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in found.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), len(s)) for i, s in sets.items()}


def best_segmentation(text, pieces):
    """``(score, tokens)`` of the best segmentation of a whole text, from its end: every
    position has the best of the pieces (or bytes) that start there; ties go to fewer tokens."""
    t = (pieces_space() + text.replace(" ", pieces_space())) if text else ""
    best = [(0.0, 0)] * (len(t) + 1)
    for i in range(len(t) - 1, -1, -1):
        options = []
        for j in range(i + 1, min(len(t), i + pieces.longest) + 1):
            if t[i:j] in pieces.ids:
                options.append((pieces.scores[t[i:j]] + best[j][0], -1 + best[j][1]))
        if t[i] not in pieces.ids:
            n = len(t[i].encode())
            options.append((n * BYTE_LOG_PROB + best[i + 1][0], -n + best[i + 1][1]))
        best[i] = max(options)
    return best[0][0], -best[0][1]


#: Log-probability of a character's byte.
BYTE_LOG_PROB = -14.0


def pieces_space():
    return "\ud800"
