"""Token ids of documents in ORC files: sorted stripes, row indexes, Bloom filters on ids.

ORC writes the id lists with its integer run-length encoding. Each file holds a range of
documents in ascending order and, per document, its place in the file, so files and stripes are
read in parallel and the place of a document in the whole stream needs one number per file.
"""

from __future__ import annotations

import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadrift.llm.common import ODD_SPACE, slices, text_bytes, tokenizer_path

END_ID = 2
SPACE = chr(0x120)  # stands for a space in byte-level vocabularies
FILE_SCHEMA = "doc_id long, shard int, at long, n_tokens long, ids array<int>"


#: Kinds of bytes: other, white space, letter or digit. Of two bytes that follow each other, white
#: space starts a piece after anything else, and other bytes after a letter or digit.
OTHER, BLANK, ALNUM = 0, 1, 2
KIND = np.array([BLANK if chr(c) in " \n\t\r" else ALNUM if c < 128 and chr(c).isalnum() else OTHER for c in range(256)], np.uint8)
STARTS = np.array([now == BLANK and before != BLANK or now == OTHER and before == ALNUM for before in range(3) for now in range(3)])
LATIN = 0xC3  # first byte of À to ÿ, all letters but two
NO_LETTER = tuple(c.encode()[1] for c in "×÷")


def piece_starts(data: np.ndarray) -> np.ndarray:
    """Flags of the bytes of UTF-8 texts that start a piece by the byte before them; see ``common.pieces``.

    Of letters that are not ASCII only those of Latin-1 are known; others make pieces longer.
    """
    kind = KIND[data]
    second = np.flatnonzero(data[:-1] == LATIN) + 1
    second = second[(data[second] != NO_LETTER[0]) & (data[second] != NO_LETTER[1])]
    kind[second], kind[second - 1] = ALNUM, ALNUM
    out = np.ones(len(data), bool)
    np.take(STARTS, kind[:-1] * np.uint8(3) + kind[1:], out=out[1:])
    return out


def values(a: pa.LargeBinaryArray) -> list[bytes]:
    """Those of an array without nulls; ``to_pylist`` makes an object more of each."""
    _, places, data = a.buffers()
    at = np.frombuffer(places, np.int64)[a.offset:a.offset + len(a) + 1].tolist() if len(a) else []
    raw = bytes(data or b"")
    return [raw[i:j] for i, j in zip(at, at[1:])]


class Encoder:
    """Ids of texts as 32-bit integers: the tokenizers library, asked once for each piece that a task
    meets again and again.

    Texts are cut and their pieces numbered in Arrow arrays, a batch at once, so Python handles each
    piece once a batch. New words that are letters after a space are encoded as one text. Its
    pre-tokens are these words, and the ids of each begin where a token begins with the space.
    """

    def __init__(self, path: str, end_id: int, most: int = 300_000, most_bytes: int = 32 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        vocab = self.tok.get_vocab()
        self.leads = np.zeros(max(vocab.values()) + 1, bool)
        self.leads[[i for t, i in vocab.items() if t.startswith(SPACE)]] = True
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.end, self.most, self.most_bytes = array("i", [end_id]).tobytes(), most, most_bytes
        self.seen, self.size, self.missed = {}, 0, 0

    def make(self, new: list[str]) -> list[bytes]:
        words = [p for p in new if p[:1] == " " and p[1:].isalpha()]
        ids = np.array(self.tok.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, np.int32)
        starts = np.flatnonzero(self.leads[ids]) if len(ids) else ids
        if len(starts) != len(words):  # not a tokenizer of that kind
            words = starts = []
        raw, cuts = ids.tobytes(), [*(4 * np.array(starts, np.int64)).tolist(), 4 * len(ids)]
        out = dict(zip(words, (raw[a:b] for a, b in zip(cuts[:-1], cuts[1:]))))
        rest = [p for p in new if p not in out]
        out.update(zip(rest, (array("i", e.ids).tobytes() for e in self.tok.encode_batch_fast(rest, add_special_tokens=False))))
        return [out[p] for p in new]

    def look_up(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces. What came first stays, as frequent pieces do; once as many others were
        missed as are kept, the texts have changed and all goes."""
        if self.missed > self.most or self.size > self.most_bytes:
            self.seen, self.size, self.missed = {}, 0, 0
        parts = list(map(self.seen.get, pieces))
        at = [i for i, p in enumerate(parts) if p is None]
        for k in range(0, len(at), 8192):
            new = [pieces[i] for i in at[k:k + 8192]]
            made = self.make([p.decode() for p in new])
            for i, ids in zip(at[k:k + 8192], made):
                parts[i] = ids
            if len(self.seen) < self.most:
                self.seen.update(zip(new, made))
                self.size += sum(map(len, new))
            else:
                self.missed += len(new)
        return parts

    def whole(self, texts: pa.Array) -> np.ndarray:
        """Flags of texts with rarer kinds of white space or with special strings; these are one piece."""
        out = pc.match_substring_regex(texts, ODD_SPACE.pattern)
        for t in self.added:
            out = pc.or_(out, pc.match_substring(texts, t))
        return out.to_numpy(zero_copy_only=False)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of the texts and all their ids, the end id after each text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, places, data = texts.buffers()
        places = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(data or b"", np.uint8)[places[0]:places[-1]]
        places = places - places[0]
        at, bounds, pieces = np.zeros(0, np.int64), np.zeros(len(places), np.int64), pa.array([], pa.large_binary())
        if len(data):
            starts = piece_starts(data)
            for i in np.flatnonzero(self.whole(texts)):
                starts[places[i]:places[i + 1]] = False
            starts[places[:-1][np.diff(places) > 0]] = True
            at = np.flatnonzero(starts)
            bounds = np.searchsorted(at, places)
            pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)])
        pieces = pieces.dictionary_encode()
        parts = [*self.look_up(values(pieces.dictionary)), self.end]
        sizes = np.fromiter(map(len, parts), np.int32, len(parts)) // 4
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))
        which = np.insert(pieces.indices.to_numpy(), bounds[1:], len(parts) - 1)
        n = np.add.reduceat(sizes[which].astype(np.int64), bounds[:-1] + np.arange(len(texts)))
        return n, lists.take(pa.array(which)).flatten().to_numpy()


def even_slices(batches, rows: int = 1024, size: int = 4 << 20):
    """Slices of so many rows, fewer of a batch with long texts."""
    for b in batches:
        yield from slices([b], max(1, min(rows, b.num_rows * size // max(1, b.column("text").nbytes))))


def encode_partition(path: str, end_id: int):
    def run(batches):
        shard, at, encoder = TaskContext.get().partitionId(), 0, Encoder(path, end_id)
        for b in even_slices(batches):
            n, flat = encoder.encode(b.column("text"))
            ends = np.cumsum(n)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.full(len(n), shard, np.int32)), pa.array(at + ends - n), pa.array(n), ids],
                names=["doc_id", "shard", "at", "n_tokens", "ids"])
            at += int(ends[-1])
    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
                      files: int | None = None, file_bytes: int = 48 << 20, stripe_bytes: int = 8 << 20, fpp: float = 0.01) -> None:
    """Encode ``docs(doc_id, text)`` and write them to ``path`` in ascending doc_id order.

    A null or empty text is the end id alone. Null ids come first; rows with one id follow each
    other in the order of their text's hash, and each keeps its own entry. Other columns are
    ignored. An empty table gives files without rows. ``files`` is the number of ranges, by default
    one for each ``file_bytes`` of text; ids that repeat can be split between files.
    """
    files = files or max(1, -(-text_bytes(docs) // file_bytes))
    placed = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
              .withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
              .repartitionByRange(files, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row"))
    (placed.select("doc_id", "text").mapInArrow(encode_partition(tokenizer or tokenizer_path(), end_id), FILE_SCHEMA)
     .write.option("compression", "snappy").option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", str(fpp)).option("orc.stripe.size", str(stripe_bytes))
     .option("orc.create.index", "true").option("orc.rows.between.memory.checks", "256").orc(path))  # a stripe ends at its size


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``doc_id, shard, at, n_tokens, ids``; for given ids only the stripes that can hold them."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def checksum(batches):
    for b in slices(batches, 512):
        ids = b.column("ids")
        flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("shard"), b.column("at"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "shard", "at", "n_tokens", "ids_crc32"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, shard`` of every document in the files at ``path``.

    ``start`` counts the ids of all documents before it: its place in its file and the ids of
    the files before. There is one row per file to add up, never one per document.
    """
    rows = read_token_files(spark, path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = (rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
             .select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    return (rows.select("doc_id", "shard", "at", "ids")
            .mapInArrow(checksum, "doc_id long, shard int, at long, n_tokens long, ids_crc32 long")
            .join(bases, "shard")
            .select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard"))
