"""SimHash near-dedup with keys from the binary Golay code.

A 64-bit fingerprint is cut into segments of 21, 21 and 22 bits. Of two fingerprints that differ
in two bits at most, one segment at least is the same in both, and the next segment differs in
two bits at most. Every 23-bit word is within three bits of one codeword of the perfect Golay
code; the codewords within four bits of a word are one, or six where the nearest is at three,
and two words that differ in two bits or fewer share one of them. So a fingerprint gets a key of
an exact segment and a codeword index for each of these, and linked fingerprints meet in one.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadrift.llm.common import rekeyed, slices
from cadrift.llm.components import components
from cadrift.session import cut

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, of the cyclic (23, 12) code
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit and width
MARKED = "uid binary, doc_id long, f long"
EMPTY = 0  # fingerprint of a text without words


def shingles(text: str, width: int) -> list[bytes]:
    """A-Z lower-cased words between ASCII white space, in runs of ``width``; fewer words are one run."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    runs = [words[i:len(words) - width + 1 + i] for i in range(width)]
    return list(map(b" ".join, zip(*runs)))


def fingerprint(text: str | None, width: int = 3, chunk: int = 1 << 15) -> int:
    """Bit i is set if it is in over half of the shingles' XXH64, repeats included."""
    import xxhash
    runs = shingles(text or "", width)
    parts = (runs[k:k + chunk] for k in range(0, len(runs), chunk))
    return majority(np.frombuffer(b"".join([xxhash.xxh64_digest(r, 42) for r in part]), np.uint8).reshape(-1, 8) for part in parts)


def majority(parts: Iterable[np.ndarray]) -> int:
    """Bits set in over half of the 8-byte rows (most significant byte first) of all ``parts``."""
    counts, n = np.zeros(64, np.int64), 0
    for h in parts:
        counts += np.unpackbits(h, axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big") if n else EMPTY


def set_fingerprint(hashes: np.ndarray, chunk: int = 1 << 15) -> int:
    """The same of 64-bit hashes that are made already."""
    return majority(hashes[k:k + chunk].astype(">u8").view(np.uint8).reshape(-1, 8) for k in range(0, len(hashes), chunk))


def fingerprints(width: int):
    def run(batches):
        for b in slices(batches):
            f = [fingerprint(t, width) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), pa.array(np.array(f, np.uint64).view(np.int64))], names=["uid", "doc_id", "f"])
    return run


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word divided by the generator."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


def golay_table() -> np.ndarray:
    """(2048, 6): for each syndrome, the words that take a word to a codeword within four bits.

    Rows of fewer than six repeat the first. Built by trying every word of up to four bits.
    """
    from itertools import combinations
    near = [[] for _ in range(2048)]
    for weight in range(5):
        words = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], np.int64)
        for w, s in zip(words.tolist(), syndromes(words).tolist()):
            if not near[s] or near[s][0].bit_count() == 3:  # the first is the nearest
                near[s].append(w)
    return np.array([(n + [n[0]] * 6)[:6] for n in near], np.int64)


def golay_keys(f: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and key of every fingerprint: 3 bits of family, 22 exact, 12 of the codeword."""
    rows, keys = [], []
    seg = [(f >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    for family in range(3):
        exact, fuzzy = seg[family], seg[(family + 1) % 3]
        words = fuzzy[:, None] ^ table[syndromes(fuzzy)]
        key = np.int64(family) << 34 | exact[:, None] << 12 | words >> 11  # the message bits of a systematic codeword
        fresh = np.ones(key.shape, bool)
        fresh[:, 1:] = key[:, 1:] != key[:, :1]
        r, _ = np.nonzero(fresh)
        rows.append(r), keys.append(key[fresh])
    return np.concatenate(rows), np.concatenate(keys)


def wide_keys(f: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and key of every fingerprint: 2 bits of family and the codewords of two segments.
    Fingerprints that differ in two bits at most in each of two segments share a key."""
    rows, keys, words, fresh = [], [], [], []
    for at, width in SEGMENTS:
        seg = (f >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)
        words.append((seg[:, None] ^ table[syndromes(seg)]) >> 11)
        fresh.append(np.concatenate([np.ones((len(f), 1), bool), words[-1][:, 1:] != words[-1][:, :1]], axis=1))
    for family, (i, j) in enumerate(((0, 1), (1, 2), (2, 0))):
        key = np.int64(family) << 24 | words[i][:, :, None] << 12 | words[j][:, None, :]
        new = fresh[i][:, :, None] & fresh[j][:, None, :]
        rows.append(np.nonzero(new)[0]), keys.append(key[new])
    return np.concatenate(rows), np.concatenate(keys)


def emit_keys(make=golay_keys):
    def run(batches):
        table = golay_table()
        for b in slices(batches, 4096):
            f = b.column("f").to_numpy()
            rows, keys = make(f.view(np.uint64), table)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(f[rows])], names=["key", "f"])
    return run


def bucket_links(most: int):
    """Linked pairs of the fingerprints that share a key, found inside the bucket."""
    def run(batches):
        for b in batches:
            one, two = [], []
            for fs in b.column("fs").to_pylist():
                x = np.array(fs, np.int64)
                i, j = np.triu_indices(len(x), 1)
                near = np.bitwise_count((x[i] ^ x[j]).view(np.uint64)) <= most
                one.append(x[i[near]]), two.append(x[j[near]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in (one, two)], names=["a", "b"])
    return run


def midpoints(batches):
    """Each fingerprint with itself and its 64 neighbours at one bit."""
    steps = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    for b in batches:
        f = b.column("f").to_numpy()
        z = f.view(np.uint64)[:, None] ^ steps
        yield pa.RecordBatch.from_arrays([pa.array(z.reshape(-1).view(np.int64)), pa.array(np.repeat(f, 65))], names=["z", "f"])


def fingerprint_links(distinct: DataFrame, bucket: int = 64) -> DataFrame:
    """``a, b``: links between the distinct fingerprints ``f`` that connect all that differ in two
    bits at most, and none that differ in more.

    Buckets of up to ``bucket`` fingerprints verify their pairs in place. Those of larger ones meet
    at midpoints instead: two fingerprints differ in two bits at most exactly if some word is
    within one bit of both, and no word is that near to more than 65. Each is linked to the least
    at the midpoint, so a dense group costs 65 rows a fingerprint and never its square.
    """
    keyed = cut(distinct.select("f").mapInArrow(emit_keys(), "key long, f long"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(keyed.join(sizes, "key"))
    near = (shared.filter(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("f").alias("fs"))
            .select("fs").mapInArrow(bucket_links(2), "a long, b long"))
    at = shared.filter(F.col("n") > bucket).select("f").distinct().mapInArrow(midpoints, "z long, f long")
    least = at.groupBy("z").agg(F.min("f").alias("b"), F.count("*").alias("n")).filter("n > 1")
    dense = at.join(least, "z").filter("f <> b").select(F.col("f").alias("a"), "b")
    return near.unionByName(dense)


def next_links(most: int, ahead: int):
    """Of rows in order of key and fingerprint, each with the first of the next ``ahead`` of its key that differs in ``most`` bits at most."""
    def run(batches):
        key = f = np.zeros(0, np.int64)
        for b in batches:
            key, f = np.concatenate([key[-ahead:], b.column("key").to_numpy()]), np.concatenate([f[-ahead:], b.column("f").to_numpy()])
            pairs, open_ = [np.zeros((0, 2), np.int64)], np.arange(len(f))
            for step in range(1, ahead + 1):
                i = open_[open_ < len(f) - step]
                near = (key[i] == key[i + step]) & (np.bitwise_count((f[i] ^ f[i + step]).view(np.uint64)) <= most)
                pairs.append(np.stack([f[i[near]], f[i[near] + step]], axis=1))
                open_ = i[~near]
            one = np.unique(np.concatenate(pairs), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(one[:, 0]), pa.array(one[:, 1])], names=["a", "b"])
    return run


def likely_links(distinct: DataFrame, most: int = 12, ahead: int = 8) -> DataFrame:
    """``a, b``: fingerprints ``f`` that differ in ``most`` bits at most, some for each that has such.

    Neighbours among those that share a key, in order: linear, whatever many share a key, and the
    many keys of one group give the same few pairs. Not all pairs: a caller needs a way for the rest.
    """
    keyed = distinct.select("f").mapInArrow(emit_keys(wide_keys), "key long, f long")
    ordered = keyed.repartitionByRange("key", "f").sortWithinPartitions("key", "f")
    return ordered.mapInArrow(next_links(most, ahead), "a long, b long").distinct()


def rooted(marked: DataFrame) -> DataFrame:
    """``f, root``: the component of each distinct fingerprint of ``marked(f, ...)``."""
    nodes = cut(marked.select("f").distinct())
    roots = components(fingerprint_links(nodes)).select(F.col("a").alias("f"), F.col("b").alias("root"))
    return nodes.join(roots, "f", "left").withColumn("root", F.coalesce("root", "f"))


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs(doc_id, text)``.

    Fingerprints of ``width``-word shingles are linked at two differing bits or fewer;
    ``component_id`` is the smallest doc_id of the connected rows. A null, empty or blank text has
    fingerprint zero and is linked like others. Repeated rows are kept; null ids get the smallest id
    of their component that is not null, or null. An empty table gives no rows; other columns are
    ignored. Equal fingerprints are one node, so copies cost nothing beyond their own row.
    """
    marked = cut(rekeyed(docs).mapInArrow(fingerprints(width), MARKED))
    least = marked.groupBy("f").agg(F.min("doc_id").alias("least"))
    roots = cut(rooted(marked).join(least, "f"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return (marked.join(roots.select("f", "root").join(ids, "root").select("f", "component_id"), "f")
            .select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id"))
