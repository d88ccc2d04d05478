"""Slow, plain versions of the operators."""

import re
import zlib

import xxhash


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sign_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def substring(rows, k=13):
    """rows: (doc_id, text); -> per row (n_words, n_removed, kept)."""
    first = {}
    for d, t in rows:
        w = blank_words(t)
        for a in range(len(w) - k + 1):
            key = tuple(w[a:a + k])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w, gone = blank_words(t), set()
        for a in range(len(w) - k + 1):
            if first[tuple(w[a:a + k])] < d:
                gone.update(range(a, a + k))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def simhash(text):
    w = blank_words(lower(text))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def groups(prints, distance=3):
    """prints: {id: fingerprint} -> {id: smallest reachable id}."""
    parent = {d: d for d in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def decontaminate(docs, items, k=13):
    """-> {doc_id: (n_words, n_hit, sorted items)}; ids are unique here."""
    own = {}
    for i, t in items:
        w = sign_words(t)
        n = min(k, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            own.setdefault(tuple(w[a:a + n]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = sign_words(t), set(), set()
        for n in {len(x) for x in own}:
            for a in range(len(w) - n + 1):
                if (got := own.get(tuple(w[a:a + n]))):
                    hit.update(range(a, a + n))
                    found |= got
        out[d] = (len(w), len(hit), sorted(found))
    return out


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def align(template, words):
    """Best local alignment over all diagonals: (score, matched); match 2, mismatch and gap -1."""
    best, before = (0, 0), [(0, 0)] * (len(words) + 1)
    for t in template:
        row = [(0, 0)]
        for j, w in enumerate(words):
            s, m = before[j]
            options = [(s + 2, m + 1) if w == t else (s - 1, m), (before[j + 1][0] - 1, before[j + 1][1]), (row[j][0] - 1, row[j][1])]
            cell = max(options, key=lambda c: c[0])
            row.append(cell if cell[0] > 0 else (0, 0))
            best = max(best, row[-1])
        before = row
    return best
