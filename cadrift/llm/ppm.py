"""Prediction by partial matching over bytes, trained on one part of the corpus.

A text is scored as its lower-cased words, a space after each, and one newline at the end. The
trie of contexts of up to ``ORDER`` bytes is kept as counts of byte strings, one longer than their
context, in a table. The chance of a symbol follows escape method D: from the longest context
known, (2c - 1) / 2n where the symbol followed it, else the escape q / 2n and the next shorter
context, without the symbols that the longer ones already held; at last a uniform choice.

Texts are dealt by hash into blocks of bounded size. A block sends each byte string and each word
it holds once, these meet their counts over the whole corpus, and the answers go back to the
blocks that asked, where every text is then added up. No task holds the trie.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadrift.llm.common import blocks_of, shuffle_parts, slices
from cadrift.session import cut

ORDER = 5
END = b" "  # the end token among words; no word is a space
HELD_OUT = 1
TEXT_BITS = 62 - 8 * (ORDER + 1)  # numbers of texts that are scored together


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def grams(words: list[bytes], order: int = ORDER) -> np.ndarray:
    """Each symbol of a text with its context, as integers; the context of the first is newlines."""
    data = b"\n" * order + b" ".join(words) + (b" \n" if words else b"\n")
    a = np.frombuffer(data, np.uint8).astype(np.int64)
    n = len(a) - order
    out = a[:n].copy()
    for k in range(1, order + 1):
        out <<= 8
        out |= a[k:k + n]
    return out


def log_chance(gram: int, nodes: list[dict | None]) -> float:
    """log10 of the chance of a symbol that did not follow its longest context in training.

    ``nodes``: followers and counts of the contexts of each length, longest first, None if unknown.
    """
    symbol, seen, out = gram & 255, set(), 0.0
    for node in nodes:
        left = {s: c for s, c in node.items() if s not in seen} if node else None
        if not left:
            continue
        n = sum(left.values())
        if symbol in left:
            return out + math.log10((2 * left[symbol] - 1) / (2 * n))
        out += math.log10(len(left) / (2 * n))
        seen |= left.keys()
    return out - math.log10(256 - len(seen))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of sorted ones, and the sums of their counts."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


class Gathered:
    """Distinct byte strings and words of a block with their counts in training texts."""

    def __init__(self):
        self.raw, self.size, self.folded = [], 0, []
        self.words: Counter = Counter()

    def add(self, words: list[bytes], train: bool) -> None:
        g = grams(words)
        self.raw.append(g << 1 | int(train))
        self.size += len(g)
        if train:
            self.words.update(words)
            self.words[END] += 1
        else:
            for w in words:
                self.words[w] += 0
            self.words[END] += 0
        if self.size > 1 << 19:
            self.fold()

    def fold(self) -> None:
        if self.size:
            both = np.sort(np.concatenate(self.raw))
            self.folded.append(summed(both >> 1, both & 1))
            self.raw, self.size = [], 0
            if sum(len(k) for k, _ in self.folded[1:]) > 1 << 20:
                self.merge()

    def merge(self) -> None:
        """Sorted runs become one, so a string is kept once however often the block holds it."""
        keys, counts = (np.concatenate(c) for c in zip(*self.folded)) if self.folded else (np.zeros(0, np.int64),) * 2
        order = np.argsort(keys, kind="stable")
        self.folded = [summed(keys[order], counts[order])]

    def __len__(self) -> int:
        return sum(len(k) for k, _ in self.folded) + len(self.words)

    def rows(self, block: int):
        self.fold()
        self.merge()
        (keys, counts), words = self.folded[0], list(self.words)
        n = len(keys) + len(words)
        gram = pa.concat_arrays([pa.array(keys), pa.nulls(len(words), pa.int64())])
        word = pa.concat_arrays([pa.nulls(len(keys), pa.binary()), pa.array(words, pa.binary())])
        count = np.concatenate([counts, np.fromiter(self.words.values(), np.int64, len(words))])
        out = pa.RecordBatch.from_arrays([gram, word, pa.array(count), pa.array(np.full(n, block, np.int32))], names=["gram", "word", "n", "block"])
        return slices([out], 1 << 16)


def gather(batches, most: int = 5_000_000):
    """Each block's strings and words, of rows in order of blocks; what a task keeps is of one block. A
    block that holds more than ``most`` or comes again is sent again."""
    held, now = Gathered(), None
    for b in slices(batches):
        for block, train, text in zip(*(b.column(c).to_pylist() for c in ("block", "train", "text"))):
            if now is not None and (block != now or len(held) > most):
                yield from held.rows(now)
                held = Gathered()
            now = block
            held.add(words_of(text), train)
    if now is not None:
        yield from held.rows(now)


def unseen_task(low: dict[int, dict[int, dict]]):
    """log10 chances of strings not in training; ``low`` has the nodes of contexts of 0 and 1 bytes."""
    def run(batches):
        for b in slices(batches, 4096):
            cols = {c: b.column(c).to_pylist() for c in b.schema.names if c != "blocks"}
            lp = []
            for i, g in enumerate(cols["gram"]):
                nodes = [{x["s"]: x["n"] for x in v} if (v := cols[f"node{k}"][i]) is not None else None for k in range(ORDER, 1, -1)]
                lp.append(log_chance(g, [*nodes, low[1].get(g >> 8 & 255), low[0].get(0)]))
            yield pa.RecordBatch.from_arrays([b.column("gram"), b.column("blocks"), pa.array(lp, pa.float64())], names=["gram", "blocks", "value"])
    return run


def gram_chances(counted: DataFrame) -> DataFrame:
    """``gram, blocks, value`` of ``gram, n, blocks``: log10 chance of each symbol in its context."""
    known = counted.filter("n > 0").select("gram", "n")
    top = known.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"))
    seen = (counted.filter("n > 0").withColumn("context", F.shiftright("gram", 8)).join(top, "context")
            .select("gram", "blocks", F.log10((2 * F.col("n") - 1) / (2 * F.col("total"))).alias("value")))
    nodes, level = {}, known
    for k in range(ORDER, -1, -1):
        if k < ORDER:
            level = level.groupBy(F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("gram")).agg(F.sum("n").alias("n"))
        if k <= 2:
            level = cut(level)  # at most 2^24 strings of three bytes
        nodes[k] = level.groupBy(F.shiftright("gram", 8).alias(f"context{k}")).agg(
            F.collect_list(F.struct(F.col("gram").bitwiseAND(255).cast("int").alias("s"), "n")).alias(f"node{k}"))
    low = {k: {r[0]: {x.s: x.n for x in r[1]} for r in nodes[k].collect()} for k in (0, 1)}  # at most 257 nodes of 256 symbols
    unseen = counted.filter("n = 0").select("gram", "blocks")
    for k in range(ORDER, 1, -1):
        context = F.shiftright("gram", 8).bitwiseAND((1 << 8 * k) - 1).alias(f"context{k}")
        unseen = unseen.withColumn(f"context{k}", context).join(nodes[k], f"context{k}", "left").drop(f"context{k}")
    return seen.unionByName(unseen.mapInArrow(unseen_task(low), "gram long, blocks array<int>, value double"))


def score_block(total: int, kinds: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        gram, word, value = (answers.column(c).combine_chunks() for c in ("gram", "word", "value"))
        is_gram = gram.is_valid().to_numpy(zero_copy_only=False)
        key, chance = gram.filter(pa.array(is_gram)).to_numpy(), value.to_numpy()[is_gram]
        order = np.argsort(key)
        key, chance = key[order], chance[order]
        count = dict(zip(word.filter(pa.array(~is_gram)).to_pylist(), value.to_numpy()[~is_gram].tolist()))
        out, scores, waiting, size = [], [], [], 0

        def add_up() -> None:
            """Scores of the texts waiting. Their strings are sorted together, text numbers in the
            low bits, so that one pass over the sorted answers finds them."""
            both = np.sort(np.concatenate(waiting))
            found = chance[np.searchsorted(key, both >> TEXT_BITS)]
            scores.extend(np.bincount(both & (1 << TEXT_BITS) - 1, found, len(waiting)).tolist())
            waiting.clear()

        for doc_id, held_out, text in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))):
            words = words_of(text)
            c = np.fromiter(map(count.__getitem__, [*words, END]), np.float64)
            base = float(np.log10((c + 0.5) / (total + 0.5 * (kinds + 1))).sum())
            g = grams(words)
            waiting.append(g << TEXT_BITS | len(waiting))
            size += len(g)
            if size > 1 << 19 or len(waiting) == 1 << TEXT_BITS:
                add_up()
                size = 0
            out.append((doc_id, held_out, len(c), int((c > 0).sum()), total, base))
        if waiting:
            add_up()
        out = [(*r, s) for r, s in zip(out, scores)]
        cols = list(zip(*out)) if out else [()] * 7
        kinds_ = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds_)})
    return run


def score_texts(docs: DataFrame, block_bytes: int = 12 << 20) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of
    ``docs(doc_id, text)``.

    Texts whose crc32 of the id is 1 modulo five are held out; all others train. ``base_score`` is
    that of smoothed word counts, ``score`` that of this model. Null and blank texts are one end
    token; a null id counts as an empty one; repeated rows train and are returned each time. An
    empty table gives no rows; other columns are ignored. ``block_bytes`` is the text of a block.
    """
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == HELD_OUT
    named, blocks = blocks_of(docs, block_bytes)
    dealt = named.select("block", "doc_id", held.alias("held_out"), (~held).alias("train"), "text")
    asked = (dealt.select("block", "train", "text").repartition(blocks, "block").sortWithinPartitions("block")
             .mapInArrow(gather, "gram long, word binary, n long, block int"))
    asked = asked.repartition(shuffle_parts(docs.sparkSession), "gram", "word")  # a block sends a key once, unless it is too large: nothing to combine before
    counted = cut(asked.groupBy("gram", "word").agg(F.sum("n").alias("n"), F.collect_set("block").alias("blocks")))
    of_words = counted.filter("word IS NOT NULL")
    sums = of_words.agg(F.sum("n"), F.sum((F.col("n") > 0).cast("long"))).first()
    chances = gram_chances(counted.filter("gram IS NOT NULL").select("gram", "n", "blocks"))
    answers = (chances.select(F.explode("blocks").alias("block"), "gram", F.lit(None).cast("binary").alias("word"), "value")
               .unionByName(of_words.select(F.explode("blocks").alias("block"), F.lit(None).cast("long").alias("gram"), "word", F.col("n").cast("double").alias("value"))))
    return (dealt.select("block", "doc_id", "held_out", "text").groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(score_block(int(sums[0] or 0), int(sums[1] or 0)),
                          "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
