"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"

#: Pieces that are encoded one by one: white space and a run of letters and digits, or white space
#: and all that follows up to the next.
PIECE = re.compile(r"[ \n\t\r]*+[^\W_]++|[ \n\t\r]*+[^ \n\t\r]++|[ \n\t\r]++")
#: Other characters that some regular expression engines take for white space.
ODD_SPACE = re.compile("[" + "".join(map(chr, [0xB, 0xC, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C),
                                            0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])) + "]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of so few rows that Python objects of one piece stay small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def row_key() -> F.Column:
    """128-bit key of ``doc_id`` and ``text``; rows that agree in both have one key."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), text).cast("binary")))


def rekeyed(docs: DataFrame) -> DataFrame:
    """``uid, doc_id, text`` of documents; ``uid`` names a row by its id and text.

    Rows that agree in both stand for one document and get the same answers, so a table can be
    scanned again and joined on ``uid`` whatever its splits are. A null text is an empty one.
    """
    return docs.select(row_key().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0


def blocks_of(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """``uid, doc_id, text, block``: documents dealt by hash into blocks of about ``block_bytes`` of
    text, and the number of blocks. What a task keeps for a block is bounded by its text."""
    blocks = max(1, -(-text_bytes(docs) // block_bytes))
    return rekeyed(docs).withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")), blocks


def pieces(text: str) -> list[str]:
    """Pieces that byte-level BPE encodes independently.

    A pre-token never has white space after other characters, nor letters or digits before
    anything else, so each run of white space starts one, and each run of letters and digits ends
    one. A text with rarer kinds of white space stays whole.
    """
    return [text] if ODD_SPACE.search(text) else PIECE.findall(text)


class PieceCache:
    """Values of pieces, made for all new pieces of a few texts at once; bounded."""

    def __init__(self, make, most: int = 250_000):
        self.make, self.most, self.seen = make, most, {}

    def of(self, texts: list[str]) -> list[Iterator]:
        cut = [pieces(t) for t in texts]
        if len(self.seen) > self.most:
            self.seen = {}
        new = list(set().union(*cut) - self.seen.keys())
        if new:
            self.seen.update(zip(new, self.make(new)))
        get = self.seen.__getitem__
        return [map(get, c) for c in cut]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the like of it that no column of ``df`` has; column names ignore case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
