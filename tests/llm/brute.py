"""The contracts of the operators, written out one document at a time."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


def roots(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for i in range(n):
        for j in linked(i):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def least_ids(ids, root):
    least = {}
    for i, r in zip(ids, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [least.get(r) for r in root]


def words(text):
    return (text or "").encode().split()


def fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i:i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(rows):
    f = np.array([fingerprint(t) for _, t in rows], np.uint64)
    root = roots(len(f), lambda i: np.flatnonzero(np.bitwise_count(f[i] ^ f[:i]) <= 2).tolist())
    return [(i, f"{x:016x}", c) for (i, _), x, c in zip(rows, f.tolist(), least_ids([i for i, _ in rows], root))]


def near_copies(rows, width=5):
    """Smallest id of each row's group."""
    w = [(t or "").encode().lower().split() for _, t in rows]
    s = [{b" ".join(x[i:i + width]) for i in range(max(1, len(x) - width + 1))} if x else set() for x in w]
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    return least_ids([i for i, _ in rows], roots(len(s), lambda i: [j for j in range(i) if near(s[i], s[j])]))


def substrings(rows, width=35):
    all_words = [words(t) for _, t in rows]
    count = Counter(tuple(w[k:k + width]) for w in all_words for k in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, all_words):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if count[tuple(w[k:k + width])] > 1:
                gone[k:k + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def lines(rows, least=10):
    key = lambda x: x.encode().strip().lower().decode()
    first, docs = {}, defaultdict(set)
    rank = lambda i: (i is not None, i or 0)
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = key(x)
            docs[k].add(i)
            first[k] = min(first.get(k, rank(i)), rank(i))
    out = []
    for i, t in rows:
        x = (t or "").split("\n")
        kept = [v for v in x if len(key(v)) < least or len(docs[key(v)]) < 2 or first[key(v)] == rank(i)]
        out.append((i, len(x), len(x) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def ppm(rows, order=5):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    tokens = [[*(t or "").encode().lower().split(), b" "] for _, t in rows]
    stream = [b"\n" * order + b"".join(w + b" " for w in t[:-1]) + b"\n" for t in tokens]
    count = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, kinds = sum(count.values()), len(count)
    trie = [defaultdict(Counter) for _ in range(order + 1)]
    for s, h in zip(stream, held):
        if not h:
            for k in range(order, len(s)):
                for o in range(order + 1):
                    trie[o][s[k - o:k]][s[k]] += 1
    out = []
    for (i, _), h, t, s in zip(rows, held, tokens, stream):
        score = 0.0
        for k in range(order, len(s)):
            seen = set()
            for o in range(order, -1, -1):
                left = {a: b for a, b in trie[o].get(s[k - o:k], {}).items() if a not in seen}
                if not left:
                    continue
                total = sum(left.values())
                if s[k] in left:
                    score += math.log10((2 * left[s[k]] - 1) / (2 * total))
                    break
                score += math.log10(len(left) / (2 * total))
                seen |= set(left)
            else:
                score -= math.log10(256 - len(seen))
        base = sum(math.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (kinds + 1))) for w in t)
        out.append((i, h, len(t), sum(count.get(w, 0) > 0 for w in t), n, base, score))
    return out


def tiles(doc, item, least):
    open_doc, open_item, out = [1] * len(doc), [1] * len(item), []
    while True:
        best = 0
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and open_item[a + n] and open_doc[b + n] and item[a + n] == doc[b + n]:
                    n += 1
                best = max(best, n)
        if best < least:
            return out
        for a in range(len(item) - best + 1):
            for b in range(len(doc) - best + 1):
                if all(open_item[a:a + best]) and all(open_doc[b:b + best]) and (item[a:a + best] == doc[b:b + best]):
                    open_item[a:a + best] = open_doc[b:b + best] = [0] * best
                    out.append((a, b, best))
                    break


def cosine_links(rows, least=0.9):
    """Rows (id, vector); vectors that link with nothing are None."""
    good = [k for k, (_, v) in enumerate(rows) if v is not None]
    x = np.array([rows[k][1] for k in good], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    root = roots(len(good), lambda i: np.flatnonzero(near[i]).tolist())
    ids = least_ids([rows[k][0] for k in good], root)
    links, comp = {k: 0 for k in range(len(rows))}, {k: rows[k][0] for k in range(len(rows))}
    for k, i in zip(good, range(len(good))):
        links[k], comp[k] = int(near[i].sum()), ids[i]
    return [(rows[k][0], links[k], comp[k], rows[k][0] is not None and rows[k][0] == comp[k]) for k in range(len(rows))]
