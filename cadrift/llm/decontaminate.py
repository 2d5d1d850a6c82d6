"""Benchmark decontamination by greedy string tiling.

Every tile is made of runs of ``least`` words that document and item share, so the words of the item
in such runs bound what tiles can cover; a document is a candidate for the items whose bound reaches
``threshold``. For each such pair the longest common runs of unmarked words are marked again and
again, longest first, found by rolling hashes; an item whose words are covered to ``threshold`` by tiles, in whatever
order, contaminates the document.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from cadrift.llm.common import free_name, rekeyed, row_key, slices
from cadrift.llm.substrings import BASES, WordHashes, found, runs
from cadrift.session import cut

WORD = re.compile(r"[^\W_]+")


def word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    """Hashes of the lower-cased runs of letters and digits."""
    words = WORD.findall((text or "").lower())
    return np.fromiter(map(known.__getitem__, [w.encode("utf-8", "surrogatepass") for w in words]), np.uint64, len(words))


def open_runs(words: np.ndarray, open_: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of runs without a marked word."""
    if len(words) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.concatenate([[0], np.cumsum(open_)])
    start = np.flatnonzero(sums[length:] - sums[:-length] == length)
    return start, runs(words, length, BASES[1])[start]


def common_runs(doc, item, open_doc, open_item, length):
    """Pairs of starts of equal open runs: each item start with the document starts it may take."""
    d, dh = open_runs(doc, open_doc, length)
    i, ih = open_runs(item, open_item, length)
    order = np.argsort(dh, kind="stable")
    d, dh = d[order], dh[order]
    lo, hi = np.searchsorted(dh, ih), np.searchsorted(dh, ih, "right")
    return [(int(s), d[a:b]) for s, a, b in zip(i, lo, hi) if b > a and (doc[d[a]:d[a] + length] == item[s:s + length]).all()]


def tile(doc: np.ndarray, item: np.ndarray, least: int = 3) -> list[tuple[int, int, int]]:
    """Tiles (item start, document start, length), longest first, then by place in the item."""
    open_doc, open_item = np.isin(doc, item), np.isin(item, doc)
    tiles, top = [], min(len(doc), len(item))
    while True:
        low, high, best = least, top, None
        while low <= high:  # a common run of some length holds one of any shorter
            mid = (low + high) // 2
            if pairs := common_runs(doc, item, open_doc, open_item, mid):
                best, low = (mid, pairs), mid + 1
            else:
                high = mid - 1
        if best is None:
            return tiles
        top, pairs = best
        for s, places in pairs:
            for d in places.tolist() if open_item[s:s + top].all() else ():
                if open_doc[d:d + top].all():
                    open_doc[d:d + top], open_item[s:s + top] = False, False
                    tiles.append((s, d, top))
                    break


class Items:
    """Benchmark items of ``fewest`` words or more: word hashes, and seeds (runs of ``least`` words)
    with the places that have them, counted through all items."""

    def __init__(self, rows: list[tuple[int, str]], least: int, fewest: int):
        known = WordHashes()
        both = [(r[0], w) for r in rows if len(w := word_hashes(r[1], known)) >= max(fewest, least)]
        self.ids, self.words, self.least = [x[0] for x in both], [x[1] for x in both], least
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.size) - self.size
        keys = np.concatenate([np.zeros(0, np.uint64), *(runs(w, least, BASES[0]) for w in self.words)])
        place = np.concatenate([np.zeros(0, np.int64), *(a + np.arange(n - least + 1) for a, n in zip(self.start, self.size))])
        order = np.argsort(keys, kind="stable")
        self.keys, self.place = keys[order], place[order]

    def candidates(self, doc: np.ndarray, threshold: float) -> list[int]:
        """Items that shared seeds cover to ``threshold``."""
        mine = runs(doc, self.least, BASES[0])
        mine = np.unique(mine[found(self.keys, mine) >= 0])
        if not len(mine):
            return []
        lo, hi = np.searchsorted(self.keys, mine), np.searchsorted(self.keys, mine, "right")
        at = np.concatenate([self.place[a:b] for a, b in zip(lo, hi)])
        words = np.unique(at[:, None] + np.arange(self.least))
        item, covered = np.unique(np.searchsorted(self.start, words, "right") - 1, return_counts=True)
        return item[covered / self.size[item] >= threshold].tolist()

    def best(self, doc: np.ndarray, least: int, threshold: float) -> tuple[int | None, float | None]:
        """Id and coverage of the item that is covered most; the smallest id among equals."""
        out = (None, None)
        for k in self.candidates(doc, threshold):
            share = sum(n for _, _, n in tile(doc, self.words[k], least)) / len(self.words[k])
            if share >= threshold and (out[1] is None or (-share, self.ids[k]) < (-out[1], out[0])):
                out = (self.ids[k], share)
        return out


def mark_task(items: Items, least: int, threshold: float, text_at: int, names: list[str]):
    def run(batches):
        known = WordHashes()
        for b in slices(batches):
            got = [items.best(word_hashes(t, known), least, threshold) for t in b.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.float64())], names=names)
    return run


def seed_task(least: int):
    """``uid, h`` of the distinct seeds of documents."""
    def run(batches):
        known = WordHashes()
        for b in slices(batches):
            keys = [np.unique(runs(word_hashes(t, known), least, BASES[0])).view(np.int64) for t in b.column("text").to_pylist()]
            n = np.fromiter(map(len, keys), np.int64, len(keys))
            yield pa.RecordBatch.from_arrays([b.column("uid").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.concatenate(keys))], names=["uid", "h"])
    return run


def place_task(least: int, fewest: int):
    """``item_id, size, at, h`` of all seeds of items, with the number of words and the seed's place."""
    def run(batches):
        for b in slices(batches):
            for i, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                held = Items([(i, t)], least, fewest)
                n = len(held.keys)
                yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array(held.size.repeat(n), pa.int64()), pa.array(held.place), pa.array(held.keys.view(np.int64))],
                                                 names=["item_id", "size", "at", "h"])
    return run


def pair_task(least: int, threshold: float):
    def run(batches):
        known = WordHashes()
        for b in slices(batches):
            share = []
            for t, x in zip(b.column("text").to_pylist(), b.column("item").to_pylist()):
                item = word_hashes(x, known)
                share.append(sum(n for _, _, n in tile(word_hashes(t, known), item, least)) / len(item))
            keep = pa.array([s >= threshold for s in share])
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("item_id"), pa.array(share)], names=["uid", "item_id", "share"]).filter(keep)
    return run


def mark(docs: DataFrame, benchmark: DataFrame, fewest: int = 5, least: int = 3, threshold: float = 0.8,
         most_words: int = 4_000_000) -> tuple[DataFrame, str, str]:
    """``docs`` with the id of the item that a document covers most and its coverage, both null
    where no item is covered to ``threshold``; and the names of these two columns.

    Words are lower-cased runs of letters and digits. Items of fewer than ``fewest`` words, null and
    empty ones match nothing; of items with equal words the smallest id counts; null item ids are
    ignored. Null and empty texts are clean. Repeated rows are kept.

    A benchmark of up to ``most_words`` words goes to the tasks, and documents are read in one
    narrow pass. A larger one meets the seeds of the documents in a shuffled join.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).filter("item_id IS NOT NULL")
    id_name, share_name = free_name(docs, "item_id"), free_name(docs, "coverage")
    schema = StructType([*docs.schema.fields, StructField(id_name, LongType()), StructField(share_name, DoubleType())])
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    if size <= most_words:
        held = Items([(r.item_id, r.text) for r in items.collect()], least, fewest)
        at = [c.lower() for c in docs.columns].index("text")
        return docs.mapInArrow(mark_task(held, least, threshold, at, schema.names), schema), id_name, share_name
    named = rekeyed(docs)
    items = cut(items.groupBy("text").agg(F.min("item_id").alias("item_id")))
    words = F.size(F.array_distinct(F.flatten(F.transform(F.collect_set("at"), lambda x: F.sequence(x, x + F.lit(least - 1))))))
    pairs = (named.select("uid", "text").mapInArrow(seed_task(least), "uid binary, h long")
             .join(items.select("item_id", "text").mapInArrow(place_task(least, fewest), "item_id long, size long, at long, h long"), "h")
             .groupBy("uid", "item_id", "size").agg(words.alias("covered"))
             .filter(F.col("covered") / F.col("size") >= threshold).select("uid", "item_id").distinct())
    shares = (named.select("uid", "text").distinct().join(pairs, "uid").join(items.withColumnRenamed("text", "item"), "item_id")
              .select("uid", "text", "item_id", "item").mapInArrow(pair_task(least, threshold), "uid binary, item_id long, share double"))
    best = shares.groupBy("uid").agg(F.min(F.struct((-F.col("share")).alias("s"), "item_id")).alias("b"))
    uid = free_name(docs, "uid")
    out = docs.withColumn(uid, row_key()).join(best.select(F.col("uid").alias(uid), F.col("b.item_id").alias(id_name), (-F.col("b.s")).alias(share_name)), uid, "left")
    return out.select(*docs.columns, id_name, share_name), id_name, share_name


def contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``doc_id, item_id, coverage`` of the rows of ``docs(doc_id, text)`` that hold a benchmark item."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, item, share = mark(docs, benchmark, **how)
    return out.filter(F.col(item).isNotNull()).select("doc_id", F.col(item).alias("item_id"), F.col(share).alias("coverage"))


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    out, item, _ = mark(docs, benchmark, **how)
    return out.filter(F.col(item).isNull()).select(*docs.columns)
