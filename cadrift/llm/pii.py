"""Personal data: spans of fixed rules, and more from a semi-Markov conditional random field.

The rules find plain forms. The model looks at islands of text around digits and at-signs. Every
run of tokens up to a bound that could be personal data is a candidate segment; features of the
whole segment (digits, check sums, groups, separators, shape, what stands beside it) score it as
each type, all other tokens score zero, and dynamic programming over segment ends chooses
boundaries and types together. It is trained here, on a bounded sample of the islands of the
given documents: rule matches are its labels, once as they are and again written in other ways
(spelled-out at-signs, other separators, a missing plus, a mistyped digit), which teaches it
forms that the rules leave out.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadrift.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]", re.I)
CHUNK = re.compile(r"\S*")
NEXT = re.compile(r"\s*\S+")
TOKEN = re.compile(r"[0-9]+|[^\W0-9_]+|\s+|.", re.S)
AT, DOT = frozenset(("@", "(at)", "[at]")), frozenset((".", "(dot)", "[dot]", "[.]"))
SPELLED = re.compile(r"[(\[](?:at|dot)[)\]]|\[\.\]", re.I)

MOST_TOKENS, MOST_CHARS = 24, 120
CODES = 1 << 12
FEATURES = 12


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48 << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str):
    end = 0
    for m in DOMAIN.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            yield start, end


def ips(text: str):
    for m in DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def cards(text: str):
    for m in NUMBER.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str):
    for m in PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end of what the rules find, in order; time is linear in the text."""
    if not TRIGGER.search(text):
        return []
    return sorted((a, k, b) for k, find in enumerate((emails, ips, cards, phones)) for a, b in find(text))


def islands(text: str) -> list[tuple[int, int]]:
    """Chunks with digits or at-signs, with one chunk before and three after, joined where they meet."""
    out: list[list[int]] = []
    end = 0
    while m := TRIGGER.search(text, end):
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        last, end = end, CHUNK.match(text, m.end()).end()
        back = start
        while back > last and text[back - 1].isspace():
            back -= 1
        while back > last and not text[back - 1].isspace():
            back -= 1
        stop = end
        for _ in range(3):
            if step := NEXT.match(text, stop):
                stop = step.end()
        if out and back <= out[-1][1]:
            out[-1][1] = stop
        else:
            out.append([back, stop])
    return [tuple(x) for x in out]


def tokens(text: str) -> list[tuple[int, int, str]]:
    """Start, end and class of tokens: ``9`` digits, ``a`` letters, a blank, a line end, ``@`` or ``.`` however spelled, else the character."""
    out, at = [], 0
    while at < len(text):
        m = SPELLED.match(text, at) or TOKEN.match(text, at)
        t = m.group()
        low = t.lower()
        kind = "9" if "0" <= t[0] <= "9" else "@" if low in AT else "." if low in DOT else \
            ("\n" if "\n" in t or "\r" in t else " ") if t.isspace() else "a" if t[0].isalpha() else t[0]
        out.append((m.start(), m.end(), kind))
        at = m.end()
    return out


def bucket(n: int, *ends: int) -> int:
    return sum(n > e for e in ends)


def beside(text: str, at: int) -> int:
    if not 0 <= at < len(text):
        return 0
    c = text[at]
    return 1 if c.isspace() else 2 if "0" <= c <= "9" else 3 if c.isalpha() else 4 + ".,;:!?-+@/()".find(c) + 1


@lru_cache(1 << 16)
def code(part: tuple) -> int:
    return zlib.crc32(repr(part).encode()) % CODES


def span_features(text: str, toks: list, i: int, j: int, digits: str, groups: list[str], shape: str) -> list[int]:
    """Codes of the features of tokens ``i`` to ``j`` as a whole; as many for each segment."""
    n = len(digits)
    parts = [
        (1, bucket(n, 0, 3, 6, 9, 11, 13, 14, 15, 16, 19)),
        (2, 14 <= n <= 19 and luhn(digits)),
        (3, min(len(groups), 6)),
        (4, len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups), shape.count(".")),
        (5, toks[i][2], digits[:2] == "00"),
        (6, *(c in shape for c in ".-/ (+@")),
        (7, shape),
        (8, beside(text, toks[i][0] - 1), beside(text, toks[i][0] - 2)),
        (9, beside(text, toks[j][1]), beside(text, toks[j][1] + 1)),
        (10, max(map(len, groups), default=0) > 4, min(map(len, groups), default=0) < 2),
        (11, shape.rsplit("@", 1)[-1].count(".") if "@" in shape else -1, toks[j][2]),
        (12, 10 <= n <= 15, shape[0]),
    ]
    return [code(p) for p in parts]


def segments_of(text: str, toks: list):
    """First token, token after the last, kinds and feature codes of segments that may be personal data, by first token.

    A segment with one at-sign may be an email, one of digits and separators an address, card or phone.
    """
    for i, (start, _, first) in enumerate(toks):
        if first not in "9a+(":
            continue
        digits, groups, shape, ats, letters = "", [], "", 0, False
        for j in range(i, min(len(toks), i + MOST_TOKENS)):
            a, b, kind = toks[j]
            if kind == "\n" or b - start > MOST_CHARS:
                break
            shape += kind
            ats += kind == "@"
            letters |= kind == "a"
            if kind == "9":
                digits += text[a:b]
                groups.append(text[a:b])
            if ats > 1 or not letters and (len(digits) > 20 or len(groups) > 8):
                break
            if kind not in "9a":
                continue
            mail, number = ats == 1 and "." in shape.rsplit("@", 1)[-1], not ats and not letters and len(digits) >= 4
            if mail or number:
                yield i, j + 1, (0,) if mail else (1, 2, 3), span_features(text, toks, i, j, digits, groups, shape)


def candidates(text: str) -> tuple[list[tuple[int, int, int]], np.ndarray, list]:
    """All segments of an island (first token, token after the last, kind), weight places of their features, and the tokens."""
    toks = tokens(text)
    rows = [(i, e, k, f) for i, e, kinds, f in segments_of(text, toks) for k in kinds]
    at = np.array([f for *_, f in rows], np.int64).reshape(-1, FEATURES) + np.array([k for _, _, k, _ in rows], np.int64)[:, None] * CODES
    return [r[:3] for r in rows], at, toks


def best_segments(text: str, toks: list, w: list[list[float]]) -> list[tuple[int, int, int]]:
    """The segmentation with the greatest sum; tokens outside segments score zero. Segments are scored
    as they come and only the best one that ends at a token is kept."""
    n = len(toks)
    best, back, done = [0.0] * (n + 1), [None] * (n + 1), 0
    for i, e, kinds, f in segments_of(text, toks):
        while done < i:  # no later segment ends there
            if best[done] >= best[done + 1]:
                best[done + 1], back[done + 1] = best[done], None
            done += 1
        for k in kinds:
            s = best[i] + sum([w[k][c] for c in f])
            if s > best[e]:
                best[e], back[e] = s, (i, e, k)
    while done < n:
        if best[done] >= best[done + 1]:
            best[done + 1], back[done + 1] = best[done], None
        done += 1
    out = []
    while n > 0:
        if back[n]:
            out.append(back[n])
        n = back[n][0] if back[n] else n - 1
    return out[::-1]


def add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def marginals(segments: list, score: np.ndarray, n: int) -> np.ndarray:
    """Chance of each segment under the model, by sums over all segmentations forwards and backwards."""
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for k, (i, e, _) in enumerate(segments):
        by_end.setdefault(e, []).append(k)
        by_start.setdefault(i, []).append(k)
    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    for e in range(1, n + 1):
        ahead[e] = ahead[e - 1]
        for k in by_end.get(e, ()):
            ahead[e] = add(ahead[e], ahead[segments[k][0]] + score[k])
    for i in range(n - 1, -1, -1):
        behind[i] = behind[i + 1]
        for k in by_start.get(i, ()):
            behind[i] = add(behind[i], behind[segments[k][1]] + score[k])
    return np.array([math.exp(min(0.0, ahead[i] + s + behind[e] - ahead[n])) for (i, e, _), s in zip(segments, score)])


def rewritten(text: str, a: int, k: int, b: int, r: random.Random) -> tuple[str, int]:
    """The text with one span written in another way, and the kind that it now has, -1 for none."""
    span = text[a:b]
    digits = "".join(c for c in span if "0" <= c <= "9")
    if k == 0:
        name, host = span.rsplit("@", 1)
        how = r.randrange(5)
        new = name + ("@", " @ ", " (at) ", "[at]", "@")[how] + host.replace(".", (" . ", ".", " (dot) ", "[dot]", ".")[how])
        if how == 4:
            new, k = name + "@" + host.split(".")[0], -1
    elif k == 1:
        parts = span.split(".")
        how = r.randrange(4)
        if how == 3:
            parts[r.randrange(4)] = str(r.randint(256, 999))
            k = -1
        new = (".", " . ", "[.]", ".")[how].join(parts)
    elif k == 2:
        how = r.randrange(4)
        if how:
            at = r.randrange(len(digits))
            digits = digits[:at] + str((int(digits[at]) + r.randint(1, 9)) % 10) + digits[at + 1:]
        sep = ("", "", " ", ".")[r.randrange(4)] if how else ("-", ".", "/")[r.randrange(3)]
        new = sep.join(digits[x:x + 4] for x in range(0, len(digits), 4))
    else:
        how = r.randrange(5)
        new = ("00" + span[1:], "(" + digits[:3] + ") " + digits[3:6] + "-" + digits[6:10], span.replace("-", "/"), span.replace(" ", ".").replace("(", "").replace(")", ""), digits[:r.randint(4, 6)])[how]
        if how == 4:
            k = -1
    return text[:a] + new + text[b:], k


def examples(texts: list[str]) -> list[tuple]:
    """Segments, codes, token counts and gold rows of islands, each as it is and with each of its spans rewritten."""
    out = []

    def learn(text: str, gold: list[tuple[int, int, int]]) -> None:
        segments, codes, toks = candidates(text)
        if not segments:
            return
        place = {s: k for k, s in enumerate(segments)}
        start, end = {t[0]: k for k, t in enumerate(toks)}, {t[1]: k + 1 for k, t in enumerate(toks)}
        rows = [place.get((start.get(a, -1), end.get(b, -1), k)) for a, k, b in gold]
        if None in rows:
            return
        held = {x for k in rows for x in range(*segments[k][:2])}
        unsure = [k for k, (i, e, kind) in enumerate(segments) if kind == 2 and not held & set(range(i, e)) and 14 <= sum(c.isdigit() for c in text[toks[i][0]:toks[e - 1][1]]) <= 19]
        if not unsure:  # a number as long as a card's that fails its check may be one all the same: no example
            out.append((segments, codes, len(toks), np.array(rows, np.int64)))

    for text in texts:
        r = random.Random(zlib.crc32(text.encode()))
        spans = base_spans(text)
        apart = [s for n, s in enumerate(spans) if not any(o[0] < s[2] and s[0] < o[2] for m, o in enumerate(spans) if m != n)]
        if len(apart) < len(spans):
            continue
        learn(text, spans)
        for n, (a, k, b) in enumerate(spans):
            for _ in range(3):
                new, kind = rewritten(text, a, k, b, r)
                move = len(new) - len(text)
                others = [(x, y, z) if z <= a else (x + move, y, z + move) for m, (x, y, z) in enumerate(spans) if m != n]
                learn(new, sorted(others + ([(a, kind, b + move)] if kind >= 0 else [])))
    return out


def fit(texts: list[str], epochs: int = 8, rate: float = 0.5) -> np.ndarray:
    """Weights by likelihood ascent with steps scaled per weight, one island at a time in a fixed order."""
    w, seen = np.zeros(len(KINDS) * CODES), np.full(len(KINDS) * CODES, 1e-6)
    rows = examples(texts)
    for epoch in range(epochs):
        random.Random(epoch).shuffle(rows)
        for segments, codes, n, gold in rows:
            gap = -marginals(segments, w[codes].sum(axis=1), n)
            gap[gold] += 1
            few = np.flatnonzero(np.abs(gap) > 1e-4)
            if len(few):
                at, inverse = np.unique(codes[few], return_inverse=True)
                g = np.bincount(inverse.ravel(), np.repeat(gap[few], codes.shape[1]), len(at)) - 1e-4 * w[at]
                seen[at] += g * g
                w[at] += rate * g / np.sqrt(seen[at])
    return w


def more_spans(text: str, base: list, w: list[list[float]]) -> list[tuple[int, int, int]]:
    """Base spans, and those of the model that overlap none of them, in order; ``w`` has weights by kind."""
    out = list(base)
    for lo, hi in islands(text):
        toks = tokens(text[lo:hi])
        near = [(a, b) for a, _, b in base if a < hi and b > lo]
        for i, e, k in best_segments(text[lo:hi], toks, w):
            a, b = lo + toks[i][0], lo + toks[e - 1][1]
            if not any(x < b and a < y for x, y in near):
                out.append((a, k, b))
    return sorted(out)


def written(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_task(weights: np.ndarray):
    def run(batches):
        w = weights.reshape(len(KINDS), -1).tolist()
        for b in slices(batches):
            cols = [[] for _ in range(6)]
            for text in b.column("text").to_pylist():
                base = base_spans(text)
                for k in range(4):
                    cols[k].append(sum(s[1] == k for s in base))
                cols[4].append(hashlib.sha256(written(base).encode()).hexdigest())
                cols[5].append(written(more_spans(text, base, w)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])],
                                             names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
    return run


def island_task(most_chars: int):
    """Islands that are not too long to learn from, with the first kind that the rules find in them."""
    def run(batches):
        for b in slices(batches):
            kinds, texts = [], []
            for text in b.column("text").to_pylist():
                for lo, hi in islands(text):
                    if hi - lo <= most_chars:
                        found = base_spans(text[lo:hi])
                        kinds.append(found[0][1] if found else -1)
                        texts.append(text[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(texts, pa.string())], names=["kind", "island"])
    return run


def train(docs: DataFrame, max_docs: int = 20_000, per_kind: int = 300, most_chars: int = 400) -> np.ndarray:
    """Weights from about ``max_docs`` documents, taken by a hash of the text; of their islands, at
    most ``per_kind`` of each first kind, and without any, are learned from."""
    n = docs.count()
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    part = text.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, max_docs / max(n, 1))) + 1)
    found = part.mapInArrow(island_task(most_chars), "kind int, island string")
    order = Window.partitionBy("kind").orderBy(F.xxhash64("island"), "island")
    rows = found.distinct().withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_kind).select("island").collect()
    return fit(sorted(r.island for r in rows))


def find_personal_data(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row of ``docs(doc_id, text)``.

    Counts and the digest are those of the rules; ``spans`` lists these and what the model adds, as
    ``kind:start:end`` in code points, end exclusive, by start and then kind. Rule matches of several
    kinds may overlap; spans of the model overlap nothing. ``weights`` are from ``train``, by default on
    ``docs``; where nothing can be learned from, nothing is added.

    Null, empty and blank texts have no spans. Very long texts are scanned in linear time. Repeated
    rows are returned each time, null ids stay null. Empty tables give no rows; other columns are ignored.
    """
    w = train(docs) if weights is None else weights
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(find_task(w), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
