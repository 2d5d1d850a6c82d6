"""How sources of a language differ in their use of terms; terms are found by Iceberg prefix refinement.

Byte prefixes of terms are counted by the documents of a language that hold them, level by level.
Each level doubles the width. A prefix that too few documents hold is discarded, and with it all
terms under it, before they are ever counted; terms that end within a level are complete there
and are kept or discarded by their own count. What a level leaves, the terms of each document that
go on below surviving prefixes, is written and is all that the next level reads.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadrift.llm.bits import SEED, Bits, bits_of, mixed
from cadrift.llm.common import slices
from cadrift.session import cut, cuts, drop_cuts

COUNTED = "lang string, source string, prefix binary, whole boolean, h long, docs long, n long"
PORTION = 2 << 20
HELD = 1 << 18

#: Lower-cased bytes of terms; 0 for all that stands between them (\x00-\x40, \x5B-\x60, \x7B-\x7F).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
LOWER[:0x41] = LOWER[0x5B:0x61] = LOWER[0x7B:0x80] = 0
#: Masks that leave the first 0 to 8 bytes of a big-endian word.
FIRST = np.array([0] + [(1 << 64) - (1 << 64 - 8 * k) for k in range(1, 9)], np.uint64)


def whole(column: str) -> Column:
    """A text column; null is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


class Terms:
    """Terms of some documents, by their places in the texts joined."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        self.at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[self.at[0]:self.at[-1]]
        self.at = self.at - self.at[0]
        self.low = LOWER[data]
        inside, first = self.low > 0, self.at[:-1][self.at[:-1] < len(data)]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[first] = False
        after[first[first > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.size = np.flatnonzero(inside & ~after) + 1 - self.start
        self.doc = np.searchsorted(self.at, self.start, side="right") - 1

    def take(self, keep: np.ndarray) -> None:
        self.start, self.size, self.doc = self.start[keep], self.size[keep], self.doc[keep]

    def words(self, width: int) -> np.ndarray:
        """The first ``width`` bytes of each term as big-endian 64-bit words, zeros behind its end."""
        padded = np.concatenate([self.low, np.zeros(8, np.uint8)])
        view = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(padded) - 7,), (1,))
        out = np.empty((len(self.start), -(-width // 8)), np.uint64)
        for k in range(out.shape[1]):
            left = np.clip(np.minimum(self.size, width) - 8 * k, 0, 8)
            out[:, k] = view[np.minimum(self.start + 8 * k, len(view) - 1)].byteswap() & FIRST[left]
        return out

    def texts(self) -> pa.Array:
        """What is left of each document: its terms, a line end after each."""
        size = self.size + 1
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - self.start, size)
        data = np.append(self.low, np.uint8(0))[at]
        data[ends - 1] = 10
        offsets = np.append(0, ends)[np.searchsorted(self.doc, np.arange(len(self.at)))].astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(self.at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def numbered(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows' first places, and the number of each row's kind."""
    _, first, kind = np.unique(words[:, 0], return_index=True, return_inverse=True)
    for k in range(1, words.shape[1]):
        values, more = np.unique(words[:, k], return_inverse=True)
        _, first, kind = np.unique(kind * len(values) + more, return_index=True, return_inverse=True)
    return first, kind


def bytes_of(words: np.ndarray) -> pa.Array:
    """Big-endian words as bytes, without zeros."""
    flat = np.ascontiguousarray(words.byteswap()).view(np.uint8)
    offsets = np.append(0, np.cumsum((flat > 0).sum(axis=1))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(flat[flat > 0])])


def portions(batches):
    """Rows in pieces of about ``PORTION`` bytes of text, or of one longer text."""
    for b in batches:
        size = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + PORTION, side="right")))
            yield b.slice(at, end - at)
            at = end


class Names:
    """Numbers of languages and of groups (lang, source)."""

    def __init__(self):
        self.langs, self.groups, self.lang_of, self.seeds = {}, {}, [], []

    def of(self, b: pa.RecordBatch) -> np.ndarray:
        import xxhash
        for lang, source in dict.fromkeys(zip(b.column("lang").to_pylist(), b.column("source").to_pylist())):
            if lang not in self.langs:
                self.langs[lang] = len(self.langs)
                self.seeds.append(xxhash.xxh64_intdigest(lang.encode(), SEED))
            if (lang, source) not in self.groups:
                self.groups[lang, source] = len(self.groups)
                self.lang_of.append(self.langs[lang])
        return np.array([self.groups[g] for g in zip(b.column("lang").to_pylist(), b.column("source").to_pylist())], np.int64)

    def hashes(self, lang: np.ndarray, words: np.ndarray) -> np.ndarray:
        return mixed(np.column_stack([np.array(self.seeds, np.uint64)[lang], words]))


def going_on(terms: Terms, lang: np.ndarray, names: Names, bits: Bits | None, width: int) -> None:
    """Only terms that go on below a prefix of ``width`` bytes that enough documents hold stay."""
    if bits is not None:
        terms.take(terms.size > width)
        terms.take(bits.have(names.hashes(lang[terms.doc], terms.words(width))))


def counted(terms: Terms, group: np.ndarray, words: np.ndarray, some: np.ndarray) -> tuple:
    """Words, group, documents and occurrences of some terms; one document counts once for a term."""
    doc, words = terms.doc[some], words[some]
    first, kind = numbered(words) if len(words) else (np.zeros(0, np.int64),) * 2
    per_doc, n = np.unique(kind * len(group) + doc, return_counts=True)
    most = int(group.max()) + 1
    key, at = np.unique(per_doc // len(group) * most + group[per_doc % len(group)], return_inverse=True)
    return words[first][key // most], key % most, np.bincount(at, minlength=len(key)), np.bincount(at, n, len(key)).astype(np.int64)


def count_task(shared, before: int, width: int):
    """Documents and occurrences of what ends within ``width`` bytes, by group, and documents of the
    prefixes of what goes on."""
    def run(batches):
        bits, names, held = Bits(*shared.value) if shared else None, Names(), []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by(["g", "prefix", "whole", "h"]).aggregate([("docs", "sum"), ("n", "sum")]).rename_columns(["g", "prefix", "whole", "h", "docs", "n"])

        def rows():
            langs, groups = pa.array(list(names.langs), pa.string()), list(names.groups)
            for b in slices(summed().combine_chunks().to_batches(), 1 << 15):
                g, ends = b.column("g").to_numpy(), b.column("whole").to_numpy(zero_copy_only=False)
                lang = np.where(ends, np.array(names.lang_of)[np.where(ends, g, 0)], g)
                source = pa.array([s for _, s in groups], pa.string()).take(pa.array(g, mask=~ends))
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang)), source, *b.columns[1:]], names=["lang", "source", "prefix", "whole", "h", "docs", "n"])

        for b in portions(batches):
            group = names.of(b)
            lang = np.array(names.lang_of)[group]
            terms = Terms(b.column("text"))
            going_on(terms, lang, names, bits, before)
            words = terms.words(width)
            for ends, by in ((True, group), (False, lang)):
                w, g, docs, n = counted(terms, by, words, (terms.size <= width) == ends)
                h = np.zeros(len(w), np.int64) if ends else names.hashes(g, w).view(np.int64)
                held.append(pa.table({"g": g, "prefix": bytes_of(w), "whole": np.full(len(w), ends), "h": h, "docs": docs, "n": n if ends else n * 0}))
            if sum(map(len, held)) > HELD:
                held = [summed()]
                if len(held[0]) > HELD // 2:
                    yield from rows()
                    held = []
        if held:
            yield from rows()
    return run


def left_task(shared, width: int):
    """Each document's terms that go on below surviving prefixes of ``width`` bytes, as its text."""
    def run(batches):
        bits, names = Bits(*shared.value), Names()
        for b in portions(batches):
            terms = Terms(b.column("text"))
            group = names.of(b)
            going_on(terms, np.array(names.lang_of)[group], names, bits, width)
            out = pa.RecordBatch.from_arrays([b.column("lang"), b.column("source"), terms.texts()], names=["lang", "source", "text"])
            yield out.filter(pa.array(np.diff(np.searchsorted(terms.doc, np.arange(b.num_rows + 1))) > 0))
    return run


def kept_terms(docs: DataFrame, least: int = 3, width: int = 4, most_bits: int = 28) -> DataFrame:
    """``lang, source, term, n``: occurrences by source of the terms that ``least`` documents of the language hold.

    ``width`` bytes are the first level. Written tables of a level go when the next one is counted.
    """
    spark = docs.sparkSession
    rows = docs.select(whole("lang"), whole("source"), whole("text").cast("binary").alias("text"))
    shared, before, kept, left = None, 0, None, []
    while True:
        counts = cut(rows.mapInArrow(count_task(shared, before, width), COUNTED)
                     .groupBy("lang", "source", "prefix", "whole", "h").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")))
        enough = cut(counts.groupBy("lang", "prefix", "whole", "h").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least))
        done = cuts()[-2:]
        ends = counts.filter("whole").join(enough.filter("whole").select("lang", "prefix"), ["lang", "prefix"], "left_semi")
        ends = cut(ends.select("lang", "source", F.col("prefix").cast("string").alias("term"), "n"))
        kept = ends if kept is None else kept.unionByName(ends)
        on = enough.filter("NOT whole").select("h")
        more = on.count()
        if more:
            bits = bits_of(on, F.col("h"), more, most_bits)
            shared = spark.sparkContext.broadcast((bits.words, bits.size))
            if before:  # beyond the second level only what is left is read again
                rows = cut(rows.mapInArrow(left_task(shared, width), "lang string, source string, text binary"))
                done, left = done + left, cuts()[-1:]
        else:
            done += left
        drop_cuts(spark, done)
        if not more:
            return kept
        before, width = width, 2 * width


def share(count: str, total: str, kinds: str) -> Column:
    """One plus the smoothed share of a term in parts of 10^9, exact."""
    return F.expr(f"1 + (CAST(1000000000 AS DECIMAL(10,0)) * (CAST({count} AS DECIMAL(19,0)) + 1)) div (CAST({total} AS DECIMAL(19,0)) + {kinds})")


def pair_block(groups: pa.Table, terms: pa.Table) -> pa.Table:
    """Sums of f over the terms of a block for all pairs of sources of its language."""
    names = groups.column("source").to_pylist()
    zero = groups.column("zero").to_numpy().astype(np.int64)
    place = {s: k for k, s in enumerate(names)}
    source = np.array([place[s] for s in terms.column("source").to_pylist()], np.int64)
    term = terms.column("term").combine_chunks().dictionary_encode()
    at, p = term.indices.to_numpy(), terms.column("p").to_numpy()
    order = np.argsort(at, kind="stable")
    at, p, source = at[order], p[order], source[order]
    kinds, sums = len(term.dictionary), np.zeros((len(names), len(names)), np.int64)
    step = max(1, (1 << 20) // max(1, len(names)))
    for a in range(0, kinds, step):
        lo, hi = np.searchsorted(at, [a, a + step])
        dense = np.repeat(zero[:, None], min(step, kinds - a), axis=1)
        dense[source[lo:hi], at[lo:hi] - a] = p[lo:hi]
        for g, own in enumerate(dense):
            gap = own - dense
            sums[g] += (gap * gap // dense).sum(axis=1)
    g, o = np.nonzero(~np.eye(len(names), dtype=bool))
    lang = groups.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "source": pa.array([names[k] for k in g], pa.string()),
                     "item": pa.array([names[k] for k in o], pa.string()), "value": pa.array(sums[g, o])})


def source_divergence(docs: DataFrame, least: int = 3, top: int = 200, block_terms: int = 1 << 14, **sizes) -> DataFrame:
    """``lang, source, part, item, value, rank`` of the groups (lang, source) of ``docs``.

    A language keeps the V terms, runs of letters with A-Z lower-cased, that ``least`` of its documents
    hold. A group, or a language, gives a term the share ``p = 1 + floor(10^9 (count + 1) / (N + V))``;
    ``f = floor((p - q)^2 / q)`` compares a group's p with another's q. Part ``pair`` has f summed over
    all kept terms for each other source of the language, part ``term`` has the ``top`` terms that the
    group uses more than its language. Ranks go by value, the largest first, then by item in byte order.

    A null text, lang or source is empty. A row is a document: repeated rows count each time, whatever
    their ids. Empty and blank texts only make their group occur; a group without terms has pairs
    and no term rows, a language without kept terms has pairs of value 0. Very long texts count
    whole. Empty tables give no rows; other columns are ignored.
    """
    groups = cut(docs.select(whole("lang"), whole("source")).distinct())
    kept = cut(kept_terms(docs, least, **sizes))
    of_lang = cut(kept.groupBy("lang", "term").agg(F.sum("n").alias("n_lang")))
    lang = of_lang.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = cut(groups.join(lang, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["v", "total_lang", "total"])
                .withColumn("none", F.lit(0).cast("long")))
    with_p = cut(kept.join(known, ["lang", "source"]).select("lang", "source", "term", "v", "total_lang", share("n", "total", "v").alias("p")))

    score = F.expr("CAST((p - q) * (p - q) div q AS BIGINT)")
    over = with_p.join(of_lang, ["lang", "term"]).withColumn("q", share("n_lang", "total_lang", "v")).filter("p > q")
    terms = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), score.alias("value"))

    zero = known.filter("v > 0").select("lang", "source", "v", share("none", "total", "v").alias("zero"))
    blocks = F.ceil(F.col("v") / block_terms).cast("int")
    copies = zero.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = with_p.withColumn("block", F.pmod(F.xxhash64("term"), blocks).cast("int"))
    sums = (copies.select("lang", "block", "source", "zero").groupBy("lang", "block")
            .cogroup(dealt.select("lang", "block", "source", "term", "p").groupBy("lang", "block"))
            .applyInArrow(pair_block, "lang string, source string, item string, value long")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    empty = known.filter("v = 0").select("lang", "source")
    nothing = (empty.join(empty.withColumnRenamed("source", "item"), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long")))
    pairs = sums.unionByName(nothing).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.unionByName(pairs.withColumn("rank", F.row_number().over(order)))
