"""Operators against their contracts, on rows that hold every odd case and on whole small tables."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cadrift.llm import (bpe, common, components, decontaminate, embeddings, lines, near_copies, ppm, quality, queries, sharding, simhash,
                         substrings, token_files)
from tests.harness import compare
from tests.llm import brute


def rows_of(df, *cols):
    return sorted(map(tuple, df.select(*cols or df.columns).collect()), key=str)


def pairs(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def library(texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(common.tokenizer_path())
    return tok, [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLES[name])[0] is None


# ------------------------------------------------------------------ 1, 3: tokens

def token_rows(docs):
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    return sorted(((i, len(ids) + 1, crc([*ids, 2])) for (i, _), ids in zip(pairs(docs), library([t for _, t in pairs(docs)])[1])), key=str)


@pytest.mark.parametrize("which", ["edge", "documents", "nothing"])
def test_token_files(spark, request, tmp_path, which):
    docs = request.getfixturevalue(which)
    token_files.write_token_files(docs, str(tmp_path / "t"), files=4)
    out = token_files.token_digest(spark, str(tmp_path / "t"))
    assert rows_of(out, "doc_id", "n_tokens", "ids_crc32") == token_rows(docs)
    at = 0
    got = sorted(out.collect(), key=lambda r: r.start)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_encoder_cuts_texts_as_the_library_does():
    """Letters, digits, odd white space and special strings in any order; sliced and empty arrays."""
    r = random.Random(5)
    signs = [" ", "  ", "\n", "\t", "a", "Z", "9", "½", "é", "×", "÷", "ß", "Ã", "—", "_", "'", "'s", "'ll", "!", "日", "🎉", "\u0301", "\x00", " the",
             "endoftext", "<|", "|>", "<|endoftext|>", "\x0b", "\xa0", "\x1c"]
    texts = [None, "", "x" * 9000] + ["".join(r.choices(signs[:len(signs) - 4 * (i % 4 > 0)], k=r.randint(0, 14))) for i in range(4000)]
    ids = [x + [2] for x in library(texts)[1]]
    encoder = token_files.Encoder(common.tokenizer_path(), 2, most=500)
    for a, b in ((0, 2), (2, 900), (900, len(texts))):
        n, flat = encoder.encode(pa.array(texts, pa.string()).slice(a, b - a))
        assert n.tolist() == [len(x) for x in ids[a:b]] and flat.tolist() == sum(ids[a:b], [])


def test_encoder_handles_a_piece_once_a_batch(monkeypatch):
    """Python looks up distinct pieces, not every occurrence."""
    asked, whole = [], token_files.Encoder.look_up
    monkeypatch.setattr(token_files.Encoder, "look_up", lambda self, pieces: asked.append(len(pieces)) or whole(self, pieces))
    n, _ = token_files.Encoder(common.tokenizer_path(), 2).encode(pa.array(["the cat, the hat\n" * 500] * 8))
    assert asked == [7] and len(n) == 8  # of 20,000


def test_token_files_prune_by_id(spark, documents, tmp_path):
    path = str(tmp_path / "t")
    token_files.write_token_files(documents, path, files=4)
    some = token_files.read_token_files(spark, path, [7, 11])
    assert sorted(r.doc_id for r in some.collect()) == [7, 11]
    assert "In(doc_id" in some._jdf.queryExecution().toString()


def test_token_files_hold_stripes_row_groups_and_blooms(spark, tmp_path):
    """Several stripes a file, each with its row groups, and far fewer rows read for one id than are there."""
    from pyarrow import orc
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    path = str(tmp_path / "t")
    token_files.write_token_files(docs, path, files=2, stripe_bytes=1 << 20)
    files = sorted((tmp_path / "t").glob("*.orc"))
    footers = [orc.ORCFile(str(f)) for f in files]
    assert len(files) == 2 and all(f.nstripes > 2 for f in footers)
    assert sum(f.nrows for f in footers) == docs.count()
    ranges = [(f.read(columns=["doc_id"]).column(0)[0].as_py(), f.read(columns=["doc_id"]).column(0)[-1].as_py()) for f in footers]
    assert ranges[0][1] < ranges[1][0] or ranges[1][1] < ranges[0][0]
    some = token_files.read_token_files(spark, path, [7])
    assert some.count() == 1
    scan = some._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    read = scan.apply("numOutputRows").value()
    some.collect()
    assert read < docs.count() / 2


@pytest.mark.parametrize("which", ["edge", "documents", "nothing"])
def test_bpe(request, which):
    docs = request.getfixturevalue(which)
    tok, ids = library([t for _, t in pairs(docs)])
    want = sorted(((i, len(x), x, tok.decode(x, skip_special_tokens=False)) for (i, _), x in zip(pairs(docs), ids)), key=str)
    assert rows_of(bpe.encode(docs)) == want
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert rows_of(bpe.encode(docs, ("n_tokens", "ids_sha256", "decoded_sha256"))) == sorted(
        ((i, n, sha(",".join(map(str, x))), sha(t)) for i, n, x, t in want), key=str)


def test_segment_tree_merges_leftmost_lowest_first():
    vocab = bpe.Vocabulary(common.tokenizer_path())
    rank = {(int(k) >> 32, int(k) & (1 << 32) - 1): int(r) for k, r in zip(vocab.key, vocab.rank)}
    r = random.Random(4)
    some = ["".join(r.choice("aehinorst ") for _ in range(r.randint(1, 40))).encode() for _ in range(300)] + [b"a" * 1000, "é".encode() * 7]
    for word, got in zip(some, bpe.encode_words(some, vocab, cells=256)):
        ids = [int(vocab.start[b]) for b in word]
        while len(ids) > 1:
            best = min(range(len(ids) - 1), key=lambda k: (rank.get((ids[k], ids[k + 1]), 1 << 60), k))
            if (ids[best], ids[best + 1]) not in rank:
                break
            ids[best:best + 2] = [int(vocab.made[rank[ids[best], ids[best + 1]]])]
        assert got == ids


# ------------------------------------------------------------------ 2: SimHash

@pytest.mark.parametrize("which", ["edge", "nothing"])
def test_simhash(request, which):
    docs = request.getfixturevalue(which)
    assert rows_of(simhash.near_duplicates(docs)) == sorted(brute.simhash(pairs(docs)), key=str)


def test_golay_keys_meet():
    table, rng = simhash.golay_table(), np.random.default_rng(1)
    f = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    g = f ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    keys = [[set() for _ in f], [set() for _ in f]]
    for side, x in zip(keys, (f, g)):
        for r, k in zip(*simhash.golay_keys(x, table)):
            side[r].add(int(k))
    assert all(a & b for a, b in zip(*keys))


@pytest.mark.parametrize("bucket", [1, 64])
def test_fingerprint_links_connect_exactly_what_is_near(spark, bucket):
    rng = np.random.default_rng(2)
    f = rng.integers(-2**62, 2**62, 40).tolist()
    for x in list(f):
        for _ in range(6):
            f.append(x ^ (1 << int(rng.integers(0, 62))) ^ (1 << int(rng.integers(0, 62))))
    f = np.unique(np.array(f, np.int64))
    links = simhash.fingerprint_links(spark.createDataFrame([(int(x),) for x in f], "f long"), bucket)
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 for a, b in links.collect())
    root = {r.a: r.b for r in components.components(links).collect()}
    want = brute.roots(len(f), lambda i: np.flatnonzero(np.bitwise_count((f[i] ^ f[:i]).view(np.uint64)) <= 2).tolist())
    assert [root.get(int(x), int(x)) for x in f] == [int(f[w]) for w in want]


def similar(groups=12, copies=9, common=0):
    """Texts with copies that differ in some words; all hold the same ``common`` words as well."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage, rows = [word() for _ in range(common)], []
    for _ in range(groups):
        base = [word() for _ in range(r.randint(90, 160))]
        for k in range(copies):
            w = list(base)
            for at in r.sample(range(len(w)), k * len(w) // 160):
                w[at] = word()
            rows.append((len(rows), " ".join(w[:40] + passage + w[40:])))
    return rows + [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, "a b c"), (len(rows) + 3, "A  b c"), (len(rows) + 4, "a b c d")]


@pytest.mark.parametrize("which", ["edge", "documents", "nothing"])
def test_near_copies_of_whole_tables(request, which):
    docs = request.getfixturevalue(which)
    rows = pairs(docs)
    out = pairs(near_copies.one_of_each(docs))
    roots = brute.near_copies(rows)
    assert len(out) == len({r for r in roots if r is not None}) + (None in roots)
    assert {i for i, _ in out if i is not None} == {r for r in roots if r is not None}


def test_near_copies_of_a_bucket_of_sets_that_are_none(spark):
    """All texts share a passage; none is near another."""
    r = random.Random(12)
    passage = " ".join(f"p{k}" for k in range(9))
    rows = [(i, passage + " " + " ".join(f"w{r.randrange(10**6)}" for _ in range(20))) for i in range(2000)]
    rows += [(3000 + k, rows[k][1]) for k in range(5)]
    out = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bucket=64)
    assert sorted(i for i, _ in pairs(out)) == list(range(2000))


@pytest.mark.parametrize("common", [0, 30])
def test_pipeline_drops_near_copies(spark, sf_dir, common):
    rows = similar(common=common)
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), sf_dir)
    want = brute.near_copies(rows)
    assert len(set(want)) < len(set(c for _, _, c in brute.simhash(rows)))
    assert sorted(i for i, _ in pairs(out)) == sorted(set(want))


def test_wide_keys_meet():
    """Two bits differ at most in each of two segments, and any in the third."""
    table, rng = simhash.golay_table(), np.random.default_rng(3)
    f = rng.integers(0, 2**64, 600, dtype=np.uint64)
    g = f.copy()
    for k, s in enumerate(rng.integers(0, 3, len(f)).tolist()):
        for family, (at, width) in enumerate(simhash.SEGMENTS):
            for bit in rng.integers(0, width, 2 if family != s else 9).tolist():
                g[k] ^= np.uint64(1 << (at + bit))
    keys = [[set() for _ in f], [set() for _ in f]]
    for side, x in zip(keys, (f, g)):
        for r, k in zip(*simhash.wide_keys(x, table)):
            side[r].add(int(k))
    assert all(a & b for a, b in zip(*keys))


def test_fingerprints_of_sets_are_those_of_texts():
    for text in ("", "a b", " ".join(f"w{k % 700}" for k in range(900))):
        h = [xxhash.xxh64_intdigest(r, 42) for r in simhash.shingles(text, 3)]
        assert simhash.set_fingerprint(np.array(h, np.uint64), 64) == simhash.fingerprint(text)


def test_pipeline_links_near_copies_by_fingerprints(spark, sf_dir, monkeypatch):
    """SimHash finds most links by itself, none below 0.8, and prefix filtering gets what it leaves."""
    rows = similar()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    links, whole = [], near_copies.verified

    def verified(found, *rest):
        out = whole(found, *rest)
        links.append([tuple(r) for r in out.collect()])
        return out

    def joined(x):
        at = {u: k for k, u in enumerate({u for p in x for u in p})}
        near = {}
        for a, b in x:
            near.setdefault(at[a], []).append(at[b])
        return len(at) - len(set(brute.roots(len(at), lambda i: near.get(i, []))))
    monkeypatch.setattr(near_copies, "verified", verified)
    out = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert sorted(i for i, _ in pairs(out)) == sorted(set(brute.near_copies(rows)))
    assert joined(links[0]) >= 0.8 * joined(sum(links, []))


def test_near_copies_of_a_dense_group(spark):
    rows = similar(groups=1, copies=6) + [(100 + i, t) for i, t in similar(groups=1, copies=4)]
    base = rows[0][1].split()
    rows += [(1000 + k, " ".join(base[:k % len(base)] + [f"w{k}"] + base[k % len(base) + 1:])) for k in range(300)]
    out = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), bucket=8)
    assert sorted(i for i, _ in pairs(out)) == sorted(set(brute.near_copies(rows)))


def test_components(spark):
    r = random.Random(1)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(9, 9), (None, 3)]
    got = {x.a: x.b for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = {}
    for a, b in links:
        if a is not None:
            near.setdefault(a, []).append(b)
    want = brute.roots(600, lambda i: near.get(i, []))
    assert [got.get(k, k) for k in range(600)] == want


# ------------------------------------------------------------------ 4: sharding

@pytest.mark.parametrize("which", ["edge", "documents", "nothing"])
def test_sharding(request, which):
    docs = request.getfixturevalue(which)
    out = sharding.assign_shards(docs, 16).collect()
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in pairs(docs)), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=str) == want
    of_text, load = {}, {}
    for r in out:
        assert of_text.setdefault(r.text_crc32, r.shard) == r.shard
        load.setdefault(r.shard, []).append(r)
    for shard, rows in load.items():
        assert 0 <= shard < 16 and sorted(r.slot for r in rows) == list(range(len(rows)))
    if which == "documents":
        sizes = [sum(r.size for r in rows) for rows in load.values()]
        assert len(sizes) == 16 and max(sizes) - min(sizes) <= 0.02 * max(sizes)


@pytest.mark.parametrize("which", ["edge", "documents"])
def test_sharding_is_that_of_all_groups_one_by_one(request, which):
    docs = request.getfixturevalue(which)
    sizes = {}
    for _, t in pairs(docs):
        t = (t or "").encode()
        sizes[t] = sizes.get(t, 0) + len(t) + 1
    want = sharding.lpt([(n, hashlib.sha256(t).digest()) for t, n in sizes.items()], 16)
    got = sharding.assign_shards(docs, 16).join(docs.select("doc_id", "text"), "doc_id").select("text", "text_crc32", "shard").distinct().collect()
    assert got
    for r in got:
        t = (r.text or "").encode()
        if zlib.crc32(t) == r.text_crc32:
            assert want[hashlib.sha256(t).digest()] == r.shard


def test_turns_are_those_of_a_heap():
    r = random.Random(4)
    for _ in range(300):
        shards = r.randint(1, 6)
        loads = [r.choice([0, r.randint(0, 400), r.randint(0, 4000)]) for _ in range(shards)]
        size, count = r.randint(1, 90), r.choice([1, 7, 64, 65, 200])
        plain, want = list(loads), []
        for _ in range(count):
            s = plain.index(min(plain))
            want.append(s)
            plain[s] += size
        runs = sharding.turns(loads, size, count)
        assert [c[k % len(c)] for a, b, c in runs for k in range(b - a)] == want and loads == plain
        assert [a for a, _, _ in runs] == [0] + [b for _, b, _ in runs][:-1] and runs[-1][1] == count


def test_lpt():
    r = random.Random(2)
    items = [(r.randint(1, 100), k) for k in range(200)]
    loads = [0] * 5
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        s = loads.index(min(loads))
        assert sharding.lpt(items, 5)[name] == s
        loads[s] += size


# ------------------------------------------------------------------ 5: substrings

@pytest.mark.parametrize("which,how", [("edge", {}), ("edge", {"block_bytes": 2000}), ("documents", {}), ("nothing", {})])
def test_substrings(request, which, how):
    docs = request.getfixturevalue(which)
    out = substrings.remove_repeats(docs, digest=True, **how)
    assert rows_of(out, "doc_id", "n_words", "n_removed", "kept") == sorted(brute.substrings(pairs(docs)), key=str)
    assert all(sum(b - a for a, b in r.spans) == r.n_removed and all(b - a >= 35 for a, b in r.spans) for r in out.collect())


# ------------------------------------------------------------------ 6: quality

def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    scored = queries.QUERIES["op6_quality"](spark, d)
    assert scored.count() == docs.count()
    rows = scored.filter("held_out").join(labels, "doc_id").select("score", "predicted", "quality").toPandas()
    good, bad = rows.score[rows.quality == 1].to_numpy(), rows.score[rows.quality == 0].to_numpy()
    assert (good[:, None] > bad).mean() > 0.99
    assert (rows.predicted == rows.quality).mean() > 0.97
    assert (rows.predicted[rows.quality == 1] == 1).mean() > 0.99


def test_quality_against_plain_updates(spark, edge):
    """Weights and scores against the published updates, written out with dictionaries."""
    import math
    import re
    import struct
    import xxhash
    labels = [(i, i % 3 == 0) for i in (*range(13), 15, 19, 31)]
    dims, epochs = 1 << 12, 3

    def plain_features(text):
        words = re.findall(r"[^\W_]+|(?:[^\w\s]|_)+", (text or "").lower())
        h = [zlib.crc32(w.encode()) for w in words]
        found = [x % dims for x in h] + [((a * 0x9E3779B1 + b * 0x85EBCA77) % 2**64 >> 13) % dims for a, b in zip(h, h[1:])]
        found += [d for d in (1, 2) for a, b in zip(h, h[d:]) if a == b]
        n = {i: found.count(i) for i in sorted(set(found))}
        return {i: math.sqrt(c) / math.sqrt(max(sum(n.values()), 1)) for i, c in n.items()}
    alpha = beta = 1.0
    l1 = l2 = 0.005
    z, n = {}, {}

    def weight(i):
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)
    first = {}
    for i, t in sorted(pairs(edge), key=lambda r: (str(r[0]), r[1] or "")):
        first.setdefault(i, t or "")
    train = [(i, int(y)) for i, y in labels if i in first and zlib.crc32(str(i).encode()) % 5]
    train.sort(key=lambda r: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", r[0]), 42)))[0])
    rows = [({**plain_features(first[i]), dims: 1.0}, y) for i, y in train]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            x, y = rows[k]
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
    table = spark.createDataFrame([(i, int(y)) for i, y in labels], "doc_id long, quality int")
    got = quality.train(edge, table, epochs=epochs, dims=dims)
    assert np.allclose(got, [weight(i) for i in range(dims + 1)], atol=1e-5) and np.count_nonzero(got) > 100
    for r in quality.score(edge.select("doc_id", "text"), got).collect():
        x = {**plain_features(r.text), dims: 1.0}
        assert r.score == pytest.approx(1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items()))), abs=1e-5)


def test_quality_edge(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (5, 1), (5, 0), (7, 9), (14, 0), (15, 1)], "doc_id long, quality int")
    weights = quality.train(edge, labels, dims=1 << 10)
    out = quality.score(edge.select("doc_id", "text"), weights)
    assert out.count() == edge.count() and out.filter("score >= 0 AND score <= 1").count() == edge.count()
    assert {r.score for r in out.filter("text IS NULL OR text = ''").collect()} == {float(quality.sigmoid(np.float64(weights[-1])))}
    for d, ls in ((edge, labels.limit(0)), (nothing, labels)):
        assert not quality.train(d, ls, dims=1 << 10).any()
    with pytest.raises(ValueError):
        quality.score(edge, weights)


# ------------------------------------------------------------------ 7: PPM

@pytest.mark.parametrize("which,how", [("edge", {}), ("edge", {"block_bytes": 3000}), ("documents", {}), ("nothing", {})])
def test_ppm(request, which, how):
    docs = request.getfixturevalue(which)
    if which == "documents":  # two in a hundred of the given table, the longest among them
        docs = docs.filter("doc_id % 50 = 0 OR length(text) > 12000")
    got = sorted(map(tuple, ppm.score_texts(docs, **how).collect()), key=lambda r: str(r[:5]))
    want = sorted(brute.ppm(pairs(docs)), key=lambda r: str(r[:5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(sorted(r[5:] for r in got), sorted(r[5:] for r in want)):
        assert g == pytest.approx(w, rel=1e-9)


def test_ppm_sends_a_string_once_a_block():
    """Also of a block whose sorted runs hold far more strings than there are distinct ones."""
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(3, 8))) for _ in range(40000)]
    texts = [" ".join(r.choices(vocabulary, k=15000)) for _ in range(110)]
    blocks = [k // 105 for k in range(110)]
    batch = pa.table({"block": pa.array(blocks, pa.int32()), "train": [k % 2 == 0 for k in range(110)], "text": texts}).to_batches(max_chunksize=8)
    sent = pa.Table.from_batches(ppm.gather(iter(batch)))
    for block in (0, 1):
        mine = [t for t, k in zip(texts, blocks) if k == block]
        grams = np.unique(np.concatenate([ppm.grams(ppm.words_of(t)) for t in mine]))
        rows = sent.filter(pc.equal(sent["block"], block))
        assert sorted(rows["gram"].drop_null().to_pylist()) == grams.tolist()
        assert sorted(rows["word"].drop_null().to_pylist()) == sorted({w.encode() for t in mine for w in t.split()} | {ppm.END})
    train = [t for k, t in enumerate(texts) if k % 2 == 0]
    assert sum(sent.filter(sent["gram"].is_valid())["n"].to_pylist()) == sum(len(ppm.grams(ppm.words_of(t))) for t in train)


# ------------------------------------------------------------------ 8: lines

@pytest.mark.parametrize("which,how", [("edge", {}), ("edge", {"shard_keys": 1, "lane_rows": 2}), ("nothing", {})])
def test_lines(request, which, how):
    docs = request.getfixturevalue(which)
    assert rows_of(lines.dedup_lines(docs, digest=True, **how)) == sorted(brute.lines(pairs(docs)), key=str)


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-2**62, 2**62, (2, 5000)), axis=1)
    keys[0, 1] = keys[0, 0]  # one first hash, two second ones
    levels = lines.build_hash(keys)
    assert sorted(lines.look_up(levels, keys).tolist()) == list(range(keys.shape[1]))


# ------------------------------------------------------------------ 9: embeddings

def vectors(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(900, 64))
    z[300:450] = z[:150] + rng.normal(size=(150, 64)) * 0.4
    z[450:650] = z[7] + rng.normal(size=(200, 64)) * 0.15
    z[650:720] = z[9] + rng.normal(size=(70, 64)) * 0.3
    z[720:740] = z[3]
    rows = [(i, x.tolist()) for i, x in enumerate(z)]
    odd = [(900, None), (901, []), (902, [0.0] * 64), (903, [1.0, None] + [0.0] * 62), (904, [float("nan")] * 64), (905, [float("inf")] * 64),
           (None, rows[3][1]), (3, rows[3][1]), (906, [1e-200] * 64), (907, [1e200] * 64)]
    df = spark.createDataFrame([(i, v, None, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, label int, cid string").repartition(3)
    good = lambda v: v if v and None not in v and np.isfinite(v).all() and any(v) else None
    scale = lambda v: None if v is None else (np.array(v) / np.abs(v).max()).tolist()
    return df, [(i, scale(good(v))) for i, v in rows + odd]


@pytest.mark.parametrize("how", [{}, {"tile_rows": 5}])
def test_embeddings(spark, how):
    df, rows = vectors(spark)
    got = sorted(map(tuple, embeddings.near_vectors(df, **how).collect()), key=str)
    want = sorted(brute.cosine_links(rows), key=str)
    assert [r[0] for r in got] == [r[0] for r in want] and all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(r[1] for r in got) >= 0.98 * sum(r[1] for r in want)
    assert sum(g != w for g, w in zip(got, want)) <= 0.02 * len(want)
    assert embeddings.near_vectors(df.limit(0)).collect() == []


def test_embeddings_of_few_dimensions_and_lengths(spark):
    rows = [(1, [1.0]), (2, [1.0, 0.0]), (3, [2.0, 0.1]), (4, [-1.0]), (5, [0.0, 1.0, 0.0])]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("vec_id").collect()
    assert [(r.n_links, r.component_id, r.kept) for r in got] == [(2, 1, True), (2, 1, False), (2, 1, False), (0, 4, True), (0, 5, True)]


# ------------------------------------------------------------------ 10: decontamination

def test_tiles():
    r, known = random.Random(1), substrings.WordHashes()
    for _ in range(150):
        doc, item = [r.choice("abcd") for _ in range(r.randint(0, 25))], [r.choice("abcd") for _ in range(r.randint(1, 12))]
        h = [decontaminate.word_hashes(" ".join(x), known) for x in (doc, item)]
        assert decontaminate.tile(*h, 2) == brute.tiles(doc, item, 2)


@pytest.mark.parametrize("most_words", [0, 4_000_000])
def test_decontaminate(spark, edge, nothing, most_words):
    r = random.Random(9)
    w = [f"w{k}" for k in range(60)]
    shuffled = w[40:60] + ["y"] + w[20:40] + ["z"] + w[:20]
    docs = [(1, "a b " + " ".join(w)), (2, " ".join(shuffled)), (3, " ".join(w[:40])), (4, " ".join(r.sample(w, 60))), (5, " ".join(w[:48]).upper() + "!"),
            (6, None), (None, " ".join(w)), (1, "a b " + " ".join(w)), (7, "one two three")]
    items = spark.createDataFrame([(8, " ".join(w)), (9, " ".join(w)), (10, None), (None, " ".join(w)), (11, "one two three"), (12, ""), (13, "other words that are in no text at all")], "item_id long, text string")
    d = spark.createDataFrame([(i, t, "x", 1.0, "u") for i, t in docs], "doc_id long, text string, item_id string, coverage double, uid string")
    got = rows_of(decontaminate.contaminated(d, items, most_words=most_words))
    assert got == sorted([(1, 8, 1.0), (1, 8, 1.0), (2, 8, 1.0), (None, 8, 1.0), (5, 8, 0.8)], key=str)
    kept = decontaminate.clean(d, items, most_words=most_words)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 7]
    assert decontaminate.contaminated(nothing, items, most_words=most_words).collect() == []
    assert decontaminate.clean(edge, items.limit(0), most_words=most_words).count() == edge.count()


@pytest.mark.parametrize("most_words", [0, 4_000_000])
def test_decontaminate_without_shared_runs_of_five(spark, most_words):
    r = random.Random(6)
    items = [(k, [f"i{k}w{n}" for n in range(r.randint(15, 40))]) for k in range(6)] + [(6, [f"i0w{n}" for n in range(4, 24)])]
    docs = []
    for _, w in items:
        for length in (2, 3, 4):
            cut = [w[n:n + length] for n in range(0, len(w), length)]
            r.shuffle(cut)
            docs.append(["x", *sum(cut, []), "y"])
        for every in (4, 5):
            docs.append([x if n % every != every - 1 else f"z{n}" for n, x in enumerate(w)])
    want = []
    for i, d in enumerate(docs):
        share = {k: sum(n for _, _, n in brute.tiles(d, w, 3)) / len(w) for k, w in items}
        best = min(share, key=lambda k: (-share[k], k))
        if share[best] >= 0.8:
            want.append((i, best, share[best]))
    assert len(want) > len(items)
    tables = [spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{name} long, text string") for name, rows in (("doc_id", enumerate(docs)), ("item_id", items))]
    assert rows_of(decontaminate.contaminated(*tables, most_words=most_words)) == sorted(want, key=str)


# ------------------------------------------------------------------ pipeline

def test_pipeline_stages(spark, sf_dir, documents):
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        seen[name] = (pairs(before), docs)
        assert name == "bpe" or docs.schema.names == documents.schema.names

    before, out = seen["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {i for i, _ in pairs(out)}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and len(kept) <= len(before)

    before, out = seen["line_dedup"]
    want = {i: s for i, _, _, s in brute.lines(before)}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in pairs(out)} == want
    assert all(r.n_chars == len(r.text) for r in out.collect())

    before, out = seen["simhash"]
    assert sorted(i for i, _ in pairs(out)) == sorted(set(brute.near_copies(before)))

    before, out = seen["decontaminate"]
    flagged = {r.doc_id for r in decontaminate.contaminated(spark.createDataFrame(before, "doc_id long, text string"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert sorted(i for i, _ in pairs(out)) == sorted(i for i, _ in before if i not in flagged)

    before, out = seen["bpe"]
    assert rows_of(out, "doc_id", "ids") == sorted(((i, x) for (i, _), x in zip(before, library([t for _, t in before])[1])), key=str)
    assert rows_of(corpus_pipeline.run(spark, sf_dir)) == rows_of(out)


def test_pipeline_stages_on_odd_rows(spark, sf_dir, edge, nothing):
    for docs in (edge, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and out.count() <= docs.count()
    rows = pairs(edge)
    assert lines.without_repeated_lines(edge).filter(F.col("text").isNull()).count() == sum(t is None for _, t in rows)
