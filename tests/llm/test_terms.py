"""Terms, phrases and personal data against SQL and brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cadrift.llm import bits, collocations, divergence, pii, queries
from tests.llm.test_ops import rows_of


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ------------------------------------------------------------------ 11: terms

def brute_divergence(rows, least=3, top=200):
    docs, groups = [], set()
    for lang, source, text in rows:
        groups.add((lang or "", source or ""))
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        docs.append((lang or "", source or "", Counter(re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low))))
    held = defaultdict(Counter)
    for lang, _, c in docs:
        held[lang].update(c.keys())
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in held.items()}
    n_of, lang_n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, c in docs:
        for t in kept[lang]:
            n_of[lang, source][t] += c[t]
            lang_n[lang][t] += c[t]

    def shares(n, terms):
        total = sum(n[t] for t in terms) + len(terms)
        return {t: 1 + 10**9 * (n[t] + 1) // total for t in terms}
    out = []
    for lang, source in groups:
        terms = kept[lang]
        p = shares(n_of[lang, source], terms)
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                q = shares(n_of[lang, other], terms)
                pairs.append((other, sum((p[t] - q[t]) ** 2 // q[t] for t in terms)))
        q = shares(lang_n[lang], terms)
        own = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in terms if n_of[lang, source][t] and p[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", own, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, i, v, k) for k, (i, v) in enumerate(items[:most], 1)]
    return sorted(out, key=str)


def odd_terms():
    """Terms of all lengths around the levels, rare and common prefixes, sources without terms."""
    r = random.Random(5)
    stem = "abcdefghijklmnopqrstuvwxyzäöüß" * 3
    word = lambda: stem[:r.choice([1, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 70])] + r.choice(["", "", "X", "Y", "ze"])
    rows = [(r.choice(["en", "de", None]), r.choice(["a", "b", "ä", None]), " ".join(word() for _ in range(r.randint(0, 30)))) for _ in range(60)]
    return rows + [("fr", "a", "one two"), ("fr", "b", None), ("it", "a", "..."), ("en", "z", "9 _ \x00 \x7f"), ("en", "a", "q" * 5000), ("en", "b", "q" * 5000), ("de", "a", "q" * 5000)] * 2


@pytest.mark.parametrize("how", [{}, {"width": 1}, {"most_bits": 10}, {"block_terms": 3}])
def test_divergence_of_odd_terms(spark, how):
    rows = odd_terms()
    docs = spark.createDataFrame([(*x, "t", 1, 2) for x in rows], "lang string, source string, text string, term string, p long, h long").repartition(5)
    assert rows_of(divergence.source_divergence(docs, **how)) == brute_divergence(rows)


def test_divergence_of_edge_rows(edge, nothing):
    rows = [tuple(r) for r in edge.select("lang", "source", "text").collect()]
    assert rows_of(divergence.source_divergence(edge)) == brute_divergence(rows)
    assert divergence.source_divergence(nothing).count() == 0


def test_bits_hold_all_keys_and_few_others(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-2**63, 2**63 - 1, 3000)
    for most in (28, 12):
        found = bits.bits_of(spark.createDataFrame([(int(k),) for k in keys], "h long"), collocations.F.col("h"), 3000, most)
        assert found.have(keys).all()
        assert most == 12 or found.have(rng.integers(-2**63, 2**63 - 1, 3000)).mean() < 0.12


# ------------------------------------------------------------------ 13: phrases

def brute_phrases(rows, least=10, inside=50, top=2000, most=3):
    count, total = Counter(), Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for n in range(1, most + 1):
                count.update((lang or "und", tuple(w[i:i + n])) for i in range(len(w) - n + 1))
    cand = {k: a for k, a in count.items() if len(k[1]) >= 2 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in cand.items():
        if any(m == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) and 100 * f >= inside * a for (m, q), f in cand.items()):
            continue
        score, k = min((10**6 * a * a // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((score, a, " ".join(p), count[lang, p[:k]], count[lang, p[k:]]))
    rows = []
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        rows += [(lang, k, p, a, l, r, total[lang], s) for k, (s, a, p, l, r) in enumerate(found[:top], 1)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("how", [{}, {"shard_words": 30}, {"most_bits": 10}, {"top": 5}, {"max_words": 4}, {"max_words": 2}])
def test_collocations(spark, how):
    r = random.Random(6)
    word = lambda: r.choice(["New", "york", "city", "of", "the", "Ünter", "b|c", "日本"])
    rows = [(r.choice(["en", None, "de"]), "".join(word() + r.choice([" ", " ", " ", "\t", ". ", "\n", "!?"]) for _ in range(r.randint(0, 25)))) for _ in range(90)]
    rows += [("en", None), ("en", ""), (None, " \t "), ("fr", "a b"), ("en", "in the new york times today " * 40)]
    docs = spark.createDataFrame([(*x, "w", 1) for x in rows], "lang string, text string, phrase string, n long").repartition(4)
    want = brute_phrases(rows, top=how.get("top", 2000), most=how.get("max_words", 3))
    assert want and rows_of(collocations.collocations(docs, **how)) == want


def test_collocations_of_edge_rows(edge, nothing):
    rows = [tuple(r) for r in edge.select("lang", "text").collect()]
    assert rows_of(collocations.collocations(edge, least=2)) == brute_phrases(rows, least=2)
    assert collocations.collocations(nothing).count() == 0


def test_intervals_of_both_transforms_hold_the_same_phrase():
    r = np.random.default_rng(3)
    s = np.concatenate([[0], r.integers(0, 5, 400), [0]]).astype(np.int32)
    kinds = 5
    counts = np.bincount(s, minlength=kinds).astype(np.int32)
    index = collocations.Index(b"\n".join(b"w%d" % k for k in range(1, kinds)), counts.tobytes(),
                               *(bits.planes(collocations.transform(x, kinds, 3)) for x in (s, s[::-1])))
    every = [bits.Bits(np.full(16, -1, np.int64).view(np.uint64), 10)] * 3
    text = s.tolist()
    for length, (ids, size, _) in enumerate(collocations.phrases(index, "en", every, 4), 2):
        want = Counter(tuple(text[i:i + length]) for i in range(len(text) - length + 1) if 0 not in text[i:i + length])
        assert dict(zip(map(tuple, ids.tolist()), size.tolist())) == want


# ------------------------------------------------------------------ 12: personal data

RULES = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    out = []
    for k, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m.group())
            if k == 0 or k == 1 and all(int(p) <= 255 for p in m.group().split(".")) or k == 2 and 14 <= len(d) <= 19 and luhn(d) or k == 3 and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_rules_on_random_text():
    r = random.Random(1)
    for _ in range(20000):
        text = "".join(r.choice("0123456789..@@ -+()ab%_5é\n") for _ in range(r.randint(1, 40)))
        assert pii.base_spans(text) == brute_spans(text)


@pytest.mark.parametrize("which", ["edge", "documents", "nothing"])
def test_personal_data(request, which):
    docs = request.getfixturevalue(which)
    got = pii.find_personal_data(docs).collect()
    want = []
    for i, t in docs.select("doc_id", "text").collect():
        base = brute_spans(t or "")
        want.append((i, *(sum(k == s[1] for s in base) for k in range(4)), hashlib.sha256(pii.written(base).encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    text = {i: t or "" for i, t in docs.select("doc_id", "text").collect()}
    for r in got:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        base = [[pii.KINDS[k], str(a), str(b)] for a, k, b in brute_spans(text[r.doc_id])] if which == "documents" else []
        assert all(s in spans for s in base)
        places = [(int(a), pii.KINDS.index(k)) for k, a, _ in spans]
        assert places == sorted(places)


def test_segments_sum_and_best_agree_with_enumeration():
    """All segmentations of a short text, one by one."""
    rng = np.random.default_rng(7)
    text = "a +12 34.5 6@b.c"
    segments, at, toks = pii.candidates(text)
    w = rng.normal(size=len(pii.KINDS) * pii.CODES)
    score = w[at].sum(axis=1)

    def each(i):
        if i == len(toks):
            yield ()
            return
        yield from each(i + 1)
        for k, (a, e, _) in enumerate(segments):
            if a == i:
                yield from ((k, *rest) for rest in each(e))
    every = list(each(0))
    weight = np.exp([score[list(s)].sum() for s in every])
    want = [sum(x for x, s in zip(weight, every) if k in s) / weight.sum() for k in range(len(segments))]
    assert np.allclose(pii.marginals(segments, score, len(toks)), want)
    best = every[int(np.argmax(weight))]
    assert pii.best_segments(text, toks, w.reshape(4, -1).tolist()) == [segments[k] for k in best]


def test_model_adds_other_forms_and_leaves_prose_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    w = pii.train(docs).reshape(4, -1).tolist()
    spans = lambda t: pii.more_spans(t, pii.base_spans(t), w)
    found = {"call 0049 30 555 1234 now": [(5, 3, 21)], "card 4111.1111.1111.1112 x": [(5, 2, 24)], "at 10.20.30 . 40 now": [(3, 1, 16)]}
    for text, want in found.items():
        assert spans(text) == want
    for text in ("version 3.12.1 of 2024-01-02 at 12:30", "token = \"9233A8ECF7C5B09FE5949719B6B82BC439E9329B\"", "Licensed under 4.0.", "in 1999 and 2001"):
        assert spans(text) == []
    held = [t for t, in docs.filter("doc_id % 7 = 3").select("text").collect()]
    prose = [t for t in held if not re.search("[0-9@]", t)]
    assert len(prose) > 500 and not any(spans(t) for t in prose)


@pytest.mark.parametrize("text", ["9" * 300000, "x" * 300000 + "@", "a@b." * 20000, "@" * 100000, "+1 " + " " * 200000, "1." * 50000])
def test_long_texts_take_linear_time(text):
    w = np.zeros((4, pii.CODES)).tolist()
    assert pii.more_spans(text, pii.base_spans(text), w) is not None


def test_oracles_are_registered():
    assert {"op11_divergence", "op13_collocations"} <= set(queries.ORACLES)
