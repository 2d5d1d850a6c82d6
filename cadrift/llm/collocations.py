"""Phrase collocations from FM-indexes over word ids, one per shard.

Each task turns its texts into shards of a bounded number of words. A shard keeps the words, how
often each occurs, and the Burrows-Wheeler transforms of its word ids read forwards and backwards,
rows ordered by as many words as a search needs. A phrase is an interval of rows in each of the
two; one step extends all phrases of a length by every word next to them, on either side, with
counts. Counts are summed across shards, and words and phrases below the least count are left
out before longer ones are asked for.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadrift.llm.bits import KEY_BITS, PACKED, SEED, Bits, bits_of, from_planes, mixed, packed, planes, sum_block
from cadrift.llm.common import slices
from cadrift.session import cut

PIECE = re.compile(rb"[^.,;:!?\x0A-\x0D]+")
WORD = re.compile(rb"[^\x20\x09]+")
SHARD = "lang string, n long, words binary, counts binary, ahead binary, back binary"
#: A row of the index holds megabytes, so row groups close after a few of them.
SMALL_GROUPS = {"compression": "zstd", "parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 2,
                "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 2}

HELD = 1 << 20


def depth_order(s: np.ndarray, kinds: int, depth: int) -> np.ndarray:
    """Positions of a cyclic sequence, ordered by the ``depth`` symbols from there on."""
    rank = s.astype(np.int64)
    for k in range(1, depth):
        rank = rank * kinds + np.roll(s, -k)
        if k + 1 < depth:
            rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    return np.argsort(rank, kind="stable")


def transform(s: np.ndarray, kinds: int, depth: int) -> np.ndarray:
    """The symbol before each row of the ordered sequence."""
    return s[depth_order(s, kinds, depth) - 1]


class Building:
    """Word ids of one language; 0 stands between pieces."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.seq: list[int] = [0]
        self.n = 0

    def add(self, text: bytes) -> None:
        ids, seq = self.ids, self.seq
        for piece in PIECE.findall(text.lower()):
            words = WORD.findall(piece)
            if words:
                seq.extend([ids.setdefault(w, len(ids) + 1) for w in words])
                seq.append(0)
                self.n += len(words)

    def row(self, lang: str, depth: int) -> tuple:
        """Words are numbered anew, the most frequent first, so that most numbers fit few bytes."""
        s, kinds = np.array(self.seq, np.int32), len(self.ids) + 1
        counts = np.bincount(s, minlength=kinds).astype(np.int32)
        order = np.append(0, 1 + np.argsort(-counts[1:], kind="stable"))
        number = np.empty(kinds, np.int32)
        number[order] = np.arange(kinds)
        words, s = list(self.ids), number[s]
        return (lang, self.n, b"\n".join([words[k - 1] for k in order[1:]]), counts[order].tobytes(), planes(transform(s, kinds, depth)), planes(transform(s[::-1], kinds, depth)))


def build_task(shard_words: int, depth: int):
    """Shards of what a task reads; all languages together hold ``shard_words`` words, or one text more."""
    def run(batches):
        def full(least: int):
            while sum(len(h.seq) for h in held.values()) > least:
                lang = max(held, key=lambda k: len(held[k].seq))
                one = held.pop(lang)
                if not one.n:
                    continue
                row = one.row(lang, depth)
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row[:2]] + [pa.array([v], pa.binary()) for v in row[2:]],
                                                 names=["lang", "n", "words", "counts", "ahead", "back"])
        held: dict[str, Building] = {}
        for b in slices(batches):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                held.setdefault(lang, Building()).add(text)
                yield from full(shard_words)
        yield from full(0)
    return run


class Index:
    """A shard read back. Rows of a symbol start at ``start`` in either transform."""

    def __init__(self, words: bytes, counts: bytes, ahead: bytes, back: bytes):
        self.words = np.array([b"", *words.split(b"\n")], object)
        self.counts = np.frombuffer(counts, np.int32).astype(np.int64)
        self.start = np.cumsum(self.counts) - self.counts
        self.ahead, self.back = (from_planes(x).astype(np.int64) for x in (ahead, back))
        self.kinds, self.n = len(self.counts), len(self.ahead)

    def places(self, seen: np.ndarray) -> np.ndarray:
        """Sorted (symbol, row) of a transform: how often a symbol is above a row is a search in it."""
        return np.sort(seen * self.n + np.arange(self.n))

    def extend(self, seen: np.ndarray, low: np.ndarray, size: np.ndarray):
        """Every symbol next to every interval: the interval's number, the symbol, how often, and how
        many smaller symbols stand there."""
        owner = np.repeat(np.arange(len(low)), size)
        rows = np.arange(len(owner)) + np.repeat(low - (np.cumsum(size) - size), size)
        both, count = np.unique(owner * self.kinds + seen[rows], return_counts=True)
        of, symbol = both // self.kinds, both % self.kinds
        before = np.cumsum(count) - count
        return of, symbol, count, before - (np.cumsum(size) - size)[of]

    def step(self, seen: np.ndarray, places: np.ndarray, low: np.ndarray, other: np.ndarray, size: np.ndarray, good: np.ndarray):
        """Intervals of all extensions by ``good`` symbols: owner, symbol, interval here, interval in the other transform, size."""
        of, symbol, count, less = self.extend(seen, low, size)
        keep = good[symbol]
        of, symbol, count, less = of[keep], symbol[keep], count[keep], less[keep]
        return of, symbol, np.searchsorted(places, symbol * self.n + low[of]), other[of] + less, count


def phrases(index: Index, lang: str, frequent: list[Bits], max_words: int):
    """Word-id rows and counts of the phrases of each length from two words on, longest last.

    ``frequent[k]`` passes the hashes of phrases of ``k + 1`` words; a phrase is extended while it and
    both of its ends pass. Even lengths extend to the right, odd ones to the left.
    """
    import xxhash
    seed = xxhash.xxh64_intdigest(lang.encode(), SEED)
    h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in index.words), np.uint64, len(index.words))
    good = frequent[0].have(h)
    good[0] = False
    ids = np.flatnonzero(good)[:, None]
    ahead = back = index.start[ids[:, 0]]
    size = index.counts[ids[:, 0]]
    places: dict[bool, np.ndarray] = {}
    for length in range(2, max_words + 1):
        if length > 2:  # the intervals of those that pass
            keep = frequent[length - 2].have(mixed(h[ids]))
            ids, ahead, back, size = ids[keep], ahead[keep], back[keep], size[keep]
        right = length % 2 == 0
        seen = index.back if right else index.ahead
        if right not in places:
            places[right] = index.places(seen)
        if right:
            of, symbol, back, ahead, size = index.step(seen, places[right], back, ahead, size, good)
            ids = np.column_stack([ids[of], symbol])
        else:
            of, symbol, ahead, back, size = index.step(seen, places[right], ahead, back, size, good)
            ids = np.column_stack([symbol, ids[of]])
        if length > 2:
            end = ids[:, 1:] if right else ids[:, :-1]
            keep = frequent[length - 2].have(mixed(h[end]))
            ids, ahead, back, size = ids[keep], ahead[keep], back[keep], size[keep]
        yield ids, size, h


def shards_of(batches):
    for b in batches:
        for i in range(b.num_rows):
            r = {c: b.column(c)[i].as_py() for c in b.schema.names}
            lang = r.pop("lang")
            yield lang, Index(**r)


def word_task():
    def run(batches):
        for b in slices(batches, 1):
            words = b.column("words")[0].as_py().split(b"\n")
            counts = np.frombuffer(b.column("counts")[0].as_py(), np.int32)[1:]
            yield pa.RecordBatch.from_arrays([pa.array([b.column("lang")[0].as_py()] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())],
                                             names=["lang", "phrase", "n"])
    return run


def hash_task(shared, length: int, blocks: int):
    """40-bit hashes of the phrases of one length, with counts, packed by their first ``blocks`` bits
    as gaps between sorted ones. Phrases that fall together are told apart by the last pass."""
    def run(batches):
        frequent = [Bits(*x) for x in shared.value]
        keys, counts = [], []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            u, at = np.unique(np.concatenate(keys), return_inverse=True)
            return u, np.bincount(at, np.concatenate(counts), len(u)).astype(np.int64)

        for lang, index in shards_of(batches):
            for ids, size, h in phrases(index, lang, frequent, length):
                pass
            keys.append(mixed(h[ids]) >> np.uint64(64 - KEY_BITS))
            counts.append(size)
            if sum(map(len, keys)) > HELD:
                keys, counts = map(list, zip(summed()))
                if len(keys[0]) > HELD // 2:
                    yield from packed(keys[0], counts[0], blocks)
                    keys, counts = [], []
        if keys and sum(map(len, keys)):
            yield from packed(*summed(), blocks)
    return run


def phrase_task(shared, max_words: int):
    """Phrases that pass, with their words and counts."""
    def run(batches):
        frequent = [Bits(*x) for x in shared.value]
        for lang, index in shards_of(batches):
            words = pa.array(index.words, pa.binary())
            for length, (ids, size, h) in enumerate(phrases(index, lang, frequent, max_words), 2):
                keep = frequent[length - 1].have(mixed(h[ids]))
                ids, size = ids[keep], size[keep]
                for i in range(0, len(ids), 1 << 16):
                    part = ids[i:i + (1 << 16)]
                    text = pc.binary_join_element_wise(*(words.take(pa.array(part[:, k])) for k in range(length)), b" ")
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([length] * len(part), pa.int32()), text, pa.array(size[i:i + (1 << 16)])],
                                                     names=["lang", "words", "phrase", "n"])
    return run


def phrase_counts(docs: DataFrame, max_words: int = 3, least: int = 10, shard_words: int = 1 << 18, most_bits: int = 28) -> tuple[DataFrame, DataFrame]:
    """``lang, words, phrase, n`` of the phrases of up to ``max_words`` words that occur ``least`` times in
    their language, and ``lang, n`` with all word occurrences."""
    spark = docs.sparkSession
    text = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    shards = cut(text.mapInArrow(build_task(shard_words, max_words - 1), SHARD), **SMALL_GROUPS)
    words = (shards.select("lang", "words", "counts").mapInArrow(word_task(), "lang string, phrase binary, n long")
             .groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    words = cut(words)
    frequent = [bits_of(words, F.xxhash64("lang", "phrase"), words.count(), most_bits)]
    index = shards.select("lang", "words", "counts", "ahead", "back")
    shared = lambda: spark.sparkContext.broadcast([(b.words, b.size) for b in frequent])
    total = shards.agg(F.sum("n")).first()[0] or 0
    blocks = min(24, max(8, (total >> 20).bit_length()))  # about a million occurrences a block at most
    for length in range(2, max_words + 1):
        keys = index.mapInArrow(hash_task(shared(), length, blocks), PACKED)
        hashed = cut(keys.groupBy("block").applyInArrow(sum_block(least, blocks), "h long"))
        frequent = [*frequent, bits_of(hashed, F.col("h"), hashed.count(), most_bits)]
    counted = (index.mapInArrow(phrase_task(shared(), max_words), "lang string, words int, phrase binary, n long")
               .groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    counts = cut(words.select("lang", F.lit(1).alias("words"), "phrase", "n").unionByName(counted)
                 .withColumn("phrase", F.col("phrase").cast("string")))
    return counts, shards.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, inside: int = 50, top: int = 2000, **sizes) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language by score.

    A phrase of 2 to ``max_words`` words that occurs ``a >= least`` times is cut into two parts that
    occur ``l`` and ``r`` times; its score is the least ``floor(1000000 * a * a / (l * r))`` over its
    cuts, ties to the shortest first part. It is left out if a longer candidate around it occurs in
    ``inside`` percent of its places or more. Ties in score go to the larger count, then to the
    smaller phrase in byte order. ``n`` counts all word occurrences of the language.

    A null language is ``und``, a null text is empty; empty and blank texts hold no words; a very
    long text is one shard of its own. Repeated rows count each time, whatever their ids. Empty tables
    give no rows; other columns are ignored.
    """
    counts, totals = phrase_counts(docs, max_words, least, **sizes)
    longer = counts.filter("words >= 2").select("lang", "words", "phrase", F.col("n").alias("a"))
    part = F.split("phrase", " ")
    joined = lambda at, n: F.array_join(F.slice(part, at, n), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(
        k.alias("k"), joined(F.lit(1), k).alias("left"), joined(k + 1, F.col("words") - k).alias("right")))
    one = longer.select("lang", "phrase", "a", F.inline(cuts))
    side = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = one.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    ratio = F.expr("CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    best = (both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(ratio.alias("score"), "k", "l", "r")).alias("cut"))
            .select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r"))
    pieces = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda k: joined(k, m))))
    around = (longer.filter("words > 2").select("lang", F.explode(pieces).alias("phrase"), F.col("a").alias("f"))
              .groupBy("lang", "phrase").agg(F.max("f").alias("f")))
    left = best.join(around, ["lang", "phrase"], "left").filter(f"f IS NULL OR 100 * f < {inside} * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (left.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
            .join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
