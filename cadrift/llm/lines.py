"""Line dedup by probing sharded minimal perfect hashes.

Distinct lines that several documents hold are counted, dealt to shards of bounded size, and
each shard becomes one row: the bit arrays of a minimal perfect hash and, by its index, arrays
of fingerprints, document counts and first documents. Documents send the hashes of their lines
to these arrays and get back which to drop; lines themselves are never joined.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadrift.llm.common import free_name, rekeyed, row_key, shuffle_parts, slices
from cadrift.session import cut

NO_ID = -(1 << 63)  # a null id, before all others
SHARD_SCHEMA = "shard int, sizes array<int>, bits binary, prints binary, counts binary, firsts binary"


def line_key(line: str) -> bytes:
    """White space of ASCII stripped from both ends, A-Z lower-cased."""
    return line.encode("utf-8", "surrogatepass").strip().lower()


def line_hashes(lines: list[str], min_chars: int) -> list[tuple[int, int] | None]:
    """Two signed 64-bit hashes per line, None for a key of fewer than ``min_chars`` code points."""
    import xxhash
    out = []
    for line in lines:
        key = line_key(line)
        if len(key) < min_chars or len(key.decode("utf-8", "surrogatepass")) < min_chars:
            out.append(None)
        else:
            d = xxhash.xxh3_128_digest(key)
            out.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
    return out


def emit_lines(min_chars: int):
    def run(batches):
        for b in slices(batches):
            uid, doc, h, g = [], [], [], []
            for u, d, t in zip(*(b.column(c).to_pylist() for c in ("uid", "doc_id", "text"))):
                for pair in set(line_hashes(t.split("\n"), min_chars)) - {None}:
                    uid.append(u), doc.append(NO_ID if d is None else d), h.append(pair[0]), g.append(pair[1])
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.binary()), pa.array(doc, pa.int64()), pa.array(h, pa.int64()), pa.array(g, pa.int64())],
                                             names=["uid", "doc", "h", "g"])
    return run


def spot(h: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of hashes in the bit array of a level."""
    x = h.view(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def build_hash(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of a minimal perfect hash of distinct keys, two hashes each and used in turn: at
    each level the keys that are alone at their place set its bit, the others go one level down."""
    levels = []
    while keys.shape[1]:
        size = max(64, keys.shape[1] * 2)
        at = spot(keys[len(levels) % 2], len(levels), size)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, bool)
        bits[at[alone]] = True
        levels.append(bits)
        keys = keys[:, ~alone]
    return levels


def look_up(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Index below the number of keys for every key; anything or -1 for what is no key."""
    index, open_, base = np.full(keys.shape[1], -1, np.int64), np.arange(keys.shape[1]), 0
    for k, bits in enumerate(levels):
        at = spot(keys[k % 2][open_], k, len(bits))
        rank = np.cumsum(bits, dtype=np.int64)
        hit = bits[at]
        index[open_[hit]] = base + rank[at[hit]] - 1
        open_, base = open_[~hit], base + int(rank[-1])
    return index


def build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    keys = rows[["h", "g"]].to_numpy().T
    levels = build_hash(keys)
    order = np.empty(keys.shape[1], np.int64)
    order[look_up(levels, keys)] = np.arange(keys.shape[1])
    arrays = [rows["g"].to_numpy()[order], np.minimum(rows["n"].to_numpy()[order], 65535).astype(np.uint16), rows["first"].to_numpy()[order]]
    return pd.DataFrame([(int(rows["shard"].iloc[0]), [len(x) for x in levels],
                          np.packbits(np.concatenate(levels)).tobytes(), *(a.tobytes() for a in arrays))],
                        columns=["shard", "sizes", "bits", "prints", "counts", "firsts"])


def probe(lines: pa.Table, shard: pa.Table) -> pa.Table:
    """Lines of one shard and lane that occur in an earlier document."""
    drop = np.zeros(0, np.int64)
    if shard.num_rows and lines.num_rows:
        s = shard.to_pylist()[0]
        bits = np.unpackbits(np.frombuffer(s["bits"], np.uint8)).astype(bool)
        ends = np.cumsum(s["sizes"])
        levels = [bits[e - n:e] for n, e in zip(s["sizes"], ends)]
        h, g, doc = (lines.column(c).to_numpy() for c in ("h", "g", "doc"))
        at = look_up(levels, np.stack([h, g]))
        same = (at >= 0) & (np.frombuffer(s["prints"], np.int64)[at] == g) & (np.frombuffer(s["counts"], np.uint16)[at] > 1)
        drop = np.flatnonzero(same & (np.frombuffer(s["firsts"], np.int64)[at] != doc))
    return lines.select(["uid", "h", "g"]).take(pa.array(drop))


def keep_lines(text: str, hits: list | None, min_chars: int) -> tuple[str, int, int]:
    """Remaining text, lines before and lines dropped."""
    lines = text.split("\n")
    if not hits:
        return text, len(lines), 0
    gone = {(x["h"], x["g"]) for x in hits}
    left = [x for x, k in zip(lines, line_hashes(lines, min_chars)) if k not in gone]
    return "\n".join(left), len(lines), len(lines) - len(left)


def report(min_chars: int, digest: bool):
    def run(batches):
        for b in slices(batches):
            rows = [keep_lines(t, h, min_chars) for t, h in zip(b.column("text").to_pylist(), b.column("hits").to_pylist())]
            kept = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() if digest else t for t, _, _ in rows]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(kept, pa.string())],
                                             names=["doc_id", "n_lines", "n_dropped", "kept"])
    return run


def rewrite(min_chars: int, text_at: int, chars_at: int | None):
    """Texts without the lines hit, and their length where a column holds it; the last column goes."""
    def run(batches):
        for b in slices(batches):
            cols, hits = list(b.columns[:-1]), b.columns[-1].to_pylist()
            old = cols[text_at].to_pylist()
            new = [t if t is None else keep_lines(t, h, min_chars)[0] for t, h in zip(old, hits)]
            cols[text_at] = pa.array(new, pa.string())
            if chars_at is not None:
                n = [c if t is None or t == o else len(t) for c, t, o in zip(cols[chars_at].to_pylist(), new, old)]
                cols[chars_at] = pa.array(n, cols[chars_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])
    return run


def line_hits(docs: DataFrame, min_chars: int = 10, shard_keys: int = 1 << 18, lane_rows: int = 1 << 20) -> DataFrame:
    """``uid, hits``: hashes of the lines that a document loses, for those that lose any.

    ``shard_keys`` bounds the keys of a shard, ``lane_rows`` the probes that reach one copy of it.
    """
    spark = docs.sparkSession
    lines = cut(rekeyed(docs).mapInArrow(emit_lines(min_chars), "uid binary, doc long, h long, g long"))
    shared = cut(lines.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"))
                 .filter("first < last").drop("last"))
    shards = max(1, -(-shared.count() // shard_keys))
    n = lines.count()
    lanes = max(1, -(-n // (shards * lane_rows)), min(-(-shuffle_parts(spark) // shards), n // (shards << 15)))
    shard = F.pmod(F.col("h"), F.lit(shards)).cast("int")
    arrays = shared.withColumn("shard", shard).groupBy("shard").applyInPandas(build_shard, SHARD_SCHEMA)
    copies = arrays.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    hits = (lines.withColumn("shard", shard).withColumn("lane", F.pmod(F.monotonically_increasing_id(), F.lit(lanes)).cast("int"))
            .groupBy("shard", "lane").cogroup(copies.groupBy("shard", "lane")).applyInArrow(probe, "uid binary, h long, g long"))
    return hits.groupBy("uid").agg(F.collect_set(F.struct("h", "g")).alias("hits"))  # at most the lines of one document


def dedup_lines(docs: DataFrame, min_chars: int = 10, digest: bool = False, **sizes) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` of every row of ``docs(doc_id, text)``.

    Lines are split at newlines; a null or empty text is one empty line. A line goes where its
    key, of ``min_chars`` code points at least, is in a document of smaller id. Rows of one id are
    one document; null ids count as one document before all others. ``kept`` is the remaining
    text, or its SHA-256 with ``digest``. Empty tables give no rows; other columns are ignored.
    """
    return (rekeyed(docs).join(line_hits(docs, min_chars, **sizes), "uid", "left").select("doc_id", "text", "hits")
            .mapInArrow(report(min_chars, digest), "doc_id long, n_lines long, n_dropped long, kept string"))


def without_repeated_lines(docs: DataFrame, min_chars: int = 10, **sizes) -> DataFrame:
    """``docs`` with the texts that ``dedup_lines`` keeps and, where there is a column ``n_chars``,
    its values for texts that changed. Null texts stay null; all rows and columns stay."""
    hits = line_hits(docs, min_chars, **sizes)
    uid, name = free_name(docs, "uid"), free_name(docs, "hits")
    lower = [c.lower() for c in docs.columns]
    return (docs.withColumn(uid, row_key()).join(hits.select(F.col("uid").alias(uid), F.col("hits").alias(name)), uid, "left")
            .select(*docs.columns, name)
            .mapInArrow(rewrite(min_chars, lower.index("text"), lower.index("n_chars") if "n_chars" in lower else None), docs.schema))
