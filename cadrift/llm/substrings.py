"""Substring dedup by seeds and extension: word runs that occur more than once are removed.

Every window of ``width`` words holds runs of ``seed`` words; the one of the least hash (the first,
among equals) is its anchor, so equal windows have equal anchors at the same offset. Anchors that
occur once end the search for their windows. The others are seeds: they are extended to both
sides as far as the windows around them reach, and windows meet their equals by a 128-bit hash.
Overlapping repeated windows join to maximal repeats, which are ``width`` words long at least.

Documents are dealt into blocks of bounded size; a block sends each hash once however often it
holds it. Occurrences meet at their hash and never each other, so a passage in a third of all
documents costs one row per block.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadrift.llm.common import blocks_of, slices
from cadrift.session import checkpoint_root, cut

BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class WordHashes(dict):
    """64-bit hash of a word, kept while few are known."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def hashed(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd ``base`` and of its inverse, modulo 2^64."""
    if n > len(POWERS.get(int(base), ((),))[0]):
        both = np.full((2, max(4096, 2 * n)), base)
        both[1] = pow(int(base), -1, 1 << 64)
        both[:, 0] = 1
        POWERS[int(base)] = tuple(np.cumprod(both, axis=1, dtype=np.uint64))
    return POWERS[int(base)]


def runs(h: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Hash of each run of ``width`` words: a polynomial in ``base``, from differences of running sums."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * down[:len(h)], out=sums[1:])
    out = (sums[width:] - sums[:-width]) * up[width - 1:width - 1 + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def anchors(h: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all seeds and, for each window, the place of its anchor."""
    g = runs(h, seed, BASES[0])
    if len(h) < width:
        return g, np.zeros(0, np.int64)
    inside = np.lib.stride_tricks.sliding_window_view(g, width - seed + 1)
    return g, inside.argmin(axis=1) + np.arange(len(inside))


class Once:
    """Distinct keys (rows of one or two hashes) and whether one came more than once."""

    def __init__(self, columns: int):
        self.columns, self.held, self.size = columns, [], 0

    def add(self, keys: np.ndarray) -> None:  # (n, columns)
        self.held.append((keys, np.zeros(len(keys), bool)))
        self.size += len(keys)
        if self.size > 1 << 20:
            self.fold()

    def fold(self) -> None:
        if not self.held:
            return
        keys, many = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort(keys.T)
        keys, many = keys[order], many[order]
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        at = np.flatnonzero(first)
        count = np.diff(np.append(at, len(keys)))
        self.held = [(keys[at], np.logical_or.reduceat(many, at) | (count > 1))] if len(at) else []
        self.size = len(at)

    def batch(self, block: int) -> pa.RecordBatch:
        self.fold()
        keys, many = self.held[0] if self.held else (np.zeros((0, self.columns), np.uint64), np.zeros(0, bool))
        signed = keys.view(np.int64)
        return pa.RecordBatch.from_arrays(
            [*(pa.array(np.ascontiguousarray(signed[:, i])) for i in range(self.columns)), pa.array(many), pa.array(np.full(len(keys), block, np.int32))],
            names=[*(f"h{i}" for i in range(self.columns)), "many", "block"])


def send_anchors(width: int, seed: int):
    def run(batches):
        known, held = WordHashes(), {}
        for b in slices(batches):
            for block, text in zip(b.column("block").to_pylist(), b.column("text").to_pylist()):
                g, at = anchors(hashed(words_of(text), known), width, seed)
                held.setdefault(block, Once(1)).add(g[np.unique(at)][:, None])
            if sum(x.size for x in held.values()) > 3_000_000:
                for block, x in held.items():
                    yield x.batch(block)
                held = {}
        for block, x in held.items():
            yield x.batch(block)
    return run


def found(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key among the sorted ones, -1 where it is not there."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def extend(width: int, seed: int):
    """Windows of a block around the seeds that occur elsewhere too."""
    def run(docs: pa.Table, seeds: pa.Table) -> pa.Table:
        out, known = Once(2), WordHashes()
        shared = np.sort(seeds.column("h0").to_numpy().view(np.uint64))
        blocks = docs.column("block").to_numpy()
        for text in docs.column("text").to_pylist() if len(shared) else ():
            h = hashed(words_of(text), known)
            g, at = anchors(h, width, seed)
            near = found(shared, g[at]) >= 0
            if near.any():
                out.add(np.stack([runs(h, width, base)[near] for base in BASES], axis=1))
        return pa.Table.from_batches([out.batch(int(blocks[0]) if len(blocks) else 0)])
    return run


def covered(h: np.ndarray, width: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Words that a repeated window covers; ``first`` is sorted."""
    one, two = (runs(h, width, base) for base in BASES)
    at = found(first, one)
    start = np.flatnonzero((at >= 0) & (second[at] == two)) if len(first) else np.zeros(0, np.int64)
    change = np.zeros(len(h) + 1, np.int64)
    change[start] += 1
    change[start + width] -= 1
    return np.cumsum(change[:-1]) > 0


def remove(width: int, digest: bool):
    def run(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        known, out = WordHashes(), [[], [], [], []]
        first, second = (repeats.column(c).to_numpy().view(np.uint64) for c in ("h0", "h1"))
        order = np.argsort(first)
        first, second = first[order], second[order]
        for text in docs.column("text").to_pylist():
            words = words_of(text)
            gone = covered(hashed(words, known), width, first, second)
            kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if gone.any() else b" ".join(words)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            row = (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "surrogatepass"),
                   edge.reshape(-1, 2).tolist())
            for c, v in zip(out, row):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
        return pa.table([docs.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["doc_id", "n_words", "n_removed", "kept", "spans"])
    return run


def repeated(sent: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, block`` of the hashes that occur more than once, one row for each block that has one."""
    return (sent.groupBy(*keys).agg((F.count("*") > 1).alias("far"), F.max("many").alias("many"), F.collect_set("block").alias("blocks"))
            .filter("far OR many").select(*keys, F.explode("blocks").alias("block")))


def remove_repeats(docs: DataFrame, width: int = 35, seed: int = 16, block_bytes: int = 16 << 20, digest: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, spans`` of every row of ``docs(doc_id, text)``.

    Words lie between ASCII white space. All words in a window of ``width`` words that starts
    anywhere else too go, in every place; ``spans`` are the maximal repeats, from word to word.
    ``kept`` is the rest joined by single spaces, or its SHA-256 with ``digest``. Null and blank
    texts have no words. Repeated rows repeat each other's text. Empty tables give no rows; null
    ids are kept; other columns are ignored.
    """
    spark = docs.sparkSession
    dealt, blocks = blocks_of(docs, block_bytes)
    name = f"blocks_{uuid.uuid4().hex}"
    (dealt.select("block", "doc_id", "text").repartition(blocks, "block").write.option("compression", "zstd")
     .option("path", f"{checkpoint_root(spark)}/{name}").bucketBy(blocks, "block").saveAsTable(name))
    texts = spark.table(name)  # bucketed: later steps read it without another shuffle

    sent = texts.select("block", "text").mapInArrow(send_anchors(width, seed), "h0 long, many boolean, block int")
    seeds = repeated(sent, ["h0"])
    windows = (texts.select("block", "text").groupBy("block").cogroup(seeds.groupBy("block"))
               .applyInArrow(extend(width, seed), "h0 long, h1 long, many boolean, block int"))
    repeats = cut(repeated(windows, ["h0", "h1"]))
    return (texts.groupBy("block").cogroup(repeats.groupBy("block"))
            .applyInArrow(remove(width, digest), "doc_id long, n_words long, n_removed long, kept string, spans array<array<long>>"))
