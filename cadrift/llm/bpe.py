"""Byte-level BPE encoding and decoding with segment trees over the ranks of adjacent pairs.

The leaf of a symbol holds the rank of the pair it forms with the next one; the root holds the
lowest rank, leftmost among equals. A merge changes three leaves, each mended along its path to
the root, until no pair can merge. Many words of like length are merged side by side, one tree
each, in arrays.
"""

from __future__ import annotations

import hashlib
import itertools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadrift.llm.common import PieceCache, slices, tokenizer_path

NONE = np.int64(1) << 62
#: Fixed pattern of byte-level pre-tokens.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in the vocabulary: printable ones for themselves, the
    others counted up from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tables of a tokenizer file: merges as sorted pair keys, bytes of each id, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        vocab = model["vocab"]
        self.bytes = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes.update({i: s.encode() for s, i in self.special.items()})
        self.start = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.start[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.decimal = {i: str(i) for i in self.bytes}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it does not merge or one side (-1) is missing."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (left >= 0) & (right >= 0), self.rank[at], NONE)


def merge_words(words: list[bytes], vocab: Vocabulary, width: int) -> list[list[int]]:
    """Ids of words of up to ``width`` bytes, a power of two: one segment tree of that many leaves each."""
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    sym = np.full((n, width + 2), -1, np.int64)  # a border on both sides: symbol i is at i + 1
    inside = np.arange(width) < size[:, None]
    sym[:, 1:-1][inside] = vocab.start[np.frombuffer(b"".join(words), np.uint8)]
    after = np.tile(np.arange(1, width + 3, dtype=np.int32), (n, 1))
    before = np.tile(np.arange(-1, width + 1, dtype=np.int32), (n, 1))
    tree = np.full((n, 2 * width), NONE)

    def leaf(rank, at):  # rank first, then place
        return np.where(rank < NONE, rank * (width + 1) + at, NONE)

    tree[:, width:] = leaf(vocab.ranks(sym[:, 1:-1].ravel(), sym[:, 2:].ravel()).reshape(n, width), np.arange(width))
    level = width
    while level > 1:
        level //= 2
        tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        root = tree[rows, 1]
        i = root % (width + 1) + 1
        j = after[rows, i]
        k, h = after[rows, j], before[rows, i]
        new = vocab.made[root // (width + 1)]
        sym[rows, i], sym[rows, j] = new, -1
        after[rows, i], before[rows, k] = k, i
        none = np.full(len(rows), NONE)
        for at, rank in ((j, none), (i, vocab.ranks(new, sym[rows, k])), (h, vocab.ranks(sym[rows, h], new))):
            ok = at > 0
            r, node = rows[ok], at[ok] - 1 + width
            tree[r, node] = leaf(rank[ok], at[ok] - 1)
            while node.size and node[0] > 1:  # all paths have one length
                node = node // 2
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
        rows = rows[tree[rows, 1] < NONE]
    body = sym[:, 1:-1]
    keep = body >= 0
    flat, ends = body[keep].tolist(), np.cumsum(keep.sum(axis=1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def encode_words(words: list[bytes], vocab: Vocabulary, cells: int = 1 << 16) -> list[list[int]]:
    """Ids of words of any lengths, batched by length; ``cells`` bounds a batch's leaves."""
    out: list[list[int]] = [[]] * len(words)
    by_width: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_width.setdefault(1 << max(1, (len(w) - 1).bit_length()), []).append(k)
    for width, mine in by_width.items():
        step = max(1, cells // width)
        for a in range(0, len(mine), step):
            for k, ids in zip(mine[a:a + step], merge_words([words[k] for k in mine[a:a + step]], vocab, width)):
                out[k] = ids
    return out


def piece_encoder(vocab: Vocabulary) -> PieceCache:
    special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True))) + ")") if vocab.special else None

    def split(piece: str) -> list:
        """Pre-tokens of a piece; special strings as their ids."""
        if piece.isalpha() or piece[:1] == " " and piece[1:].isalpha():
            return [piece]
        if special is None or not special.search(piece):
            return PRETOKEN.findall(piece)
        cut = special.split(piece)
        return [w for i, s in enumerate(cut) for w in ((vocab.special[s],) if i % 2 else PRETOKEN.findall(s))]

    def make(new: list[str]) -> list[tuple[int, ...]]:
        parts = list(map(split, new))
        words = list({w for p in parts for w in p if type(w) is str})
        ids = dict(zip(words, encode_words([w.encode("utf-8", "surrogatepass") for w in words], vocab)))
        ids.update({i: (i,) for i in vocab.special.values()})
        return [ids[p[0]] if len(p) == 1 else tuple(itertools.chain.from_iterable(map(ids.__getitem__, p))) for p in parts]

    return PieceCache(make)


#: Columns that can be asked for, with their kinds in Arrow and SQL.
COLUMNS = {"n_tokens": (pa.int64(), "long"), "ids": (pa.list_(pa.int32()), "array<int>"), "decoded": (pa.string(), "string"),
           "ids_sha256": (pa.string(), "string"), "decoded_sha256": (pa.string(), "string")}


def encode_task(path: str, columns: tuple[str, ...]):
    def run(batches):
        vocab = Vocabulary(path)
        cache = piece_encoder(vocab)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        decode = lambda ids: b"".join(map(vocab.bytes.__getitem__, ids)).decode("utf-8", "replace")
        make = {"n_tokens": len, "ids": list, "decoded": decode, "decoded_sha256": lambda ids: sha(decode(ids).encode()),
                "ids_sha256": lambda ids: sha(",".join(map(vocab.decimal.__getitem__, ids)).encode())}
        for b in slices(batches, 128):
            out = [[] for _ in columns]
            for parts in cache.of([t or "" for t in b.column("text").to_pylist()]):
                ids = list(itertools.chain.from_iterable(parts))
                for c, name in zip(out, columns):
                    c.append(make[name](ids))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, COLUMNS[name][0]) for c, name in zip(out, columns))], names=["doc_id", *columns])
    return run


def encode(docs: DataFrame, columns: tuple[str, ...] = ("n_tokens", "ids", "decoded"), tokenizer: str | None = None) -> DataFrame:
    """``doc_id`` and ``columns`` of every row of ``docs(doc_id, text)``, in one narrow pass.

    ``decoded`` is the text that the ids give back; ``ids_sha256`` is of the decimal ids joined by
    commas, ``decoded_sha256`` of that text. A null text is empty and has no ids; special strings
    in a text get their own ids. Repeated rows and null ids are kept; other columns are ignored.
    """
    schema = ", ".join(["doc_id long", *(f"{c} {COLUMNS[c][1]}" for c in columns)])
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(encode_task(tokenizer or tokenizer_path(), columns), schema))
