"""Near copies by the Jaccard similarity of their word shingles: SimHash, then prefix filtering.

Texts whose SimHash fingerprints are near are verified on the whole sets first, and linked. What
these links leave unconnected is searched by prefix filtering, which misses no pair.

Two sets of a similarity of 0.8 or more lack at most a fifth of each other. With the elements of
all sets in one order, the first that both hold is then among the first ``n // 5 + 1`` of each, so
sets that share none of these are no near copies. The others are verified on the whole sets.

Any order will do for that. Shingles that many documents hold come last in it, so a passage in a
hundredth of all documents does not make these meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadrift.llm.bits import KEY_BITS, PACKED, Bits, bits_of, packed, sum_block
from cadrift.llm.common import free_name, rekeyed, row_key, slices
from cadrift.llm.components import components
from cadrift.llm.simhash import likely_links, set_fingerprint, shingles
from cadrift.llm.substrings import found
from cadrift.session import cut, cuts, drop_cuts

HELD = 1 << 20


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    import xxhash
    return np.unique(np.array(list(map(xxhash.xxh3_64_intdigest, shingles(text or "", width))), np.uint64))


def name_of(s: np.ndarray) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(s.tobytes())


def prefix(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first ``n // 5 + 1`` elements, those of ``common`` (sorted) after all others."""
    late = found(common, s) >= 0
    return np.concatenate([s[~late], s[late]])[:len(s) // 5 + 1]


def long_array(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def name_task(width: int):
    def run(batches):
        for b in slices(batches):
            u, f = zip(*((name_of(s), set_fingerprint(s)) for s in (shingle_set(t, width) for t in b.column("text").to_pylist())))
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), long_array(u), long_array(f)], names=["uid", "doc_id", "u", "f"])
    return run


def shingle_task(width: int):
    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([long_array(np.concatenate([shingle_set(t, width) for t in b.column("text").to_pylist()]))], names=["key"])
    return run


def prefixes(b: pa.RecordBatch, width: int, common: np.ndarray) -> tuple[dict[int, np.ndarray], list[np.ndarray]]:
    """Distinct sets of some texts by name, and the prefix of each."""
    sets = {name_of(s): s for s in (shingle_set(t, width) for t in b.column("text").to_pylist())}
    return sets, [prefix(s, common) for s in sets.values()]


def meeting_task(width: int, common: np.ndarray, blocks: int):
    """Prefix elements as 40-bit keys with counts, packed; a set counts once for an element in a batch."""
    def run(batches):
        held: list[np.ndarray] = []
        for b in slices(batches):
            held += prefixes(b, width, common)[1]
            if sum(map(len, held)) > HELD:
                yield from packed(*np.unique(np.concatenate(held) >> np.uint64(64 - KEY_BITS), return_counts=True), blocks)
                held = []
        if held:
            yield from packed(*np.unique(np.concatenate(held) >> np.uint64(64 - KEY_BITS), return_counts=True), blocks)
    return run


def prefix_task(width: int, common: np.ndarray, shared):
    """``key, u, n, p``: what others may hold too of the prefix of each set, with the set's name and size and the place in it."""
    def run(batches):
        met = Bits(*shared.value)
        for b in slices(batches):
            sets, first = prefixes(b, width, common)
            k = [len(x) for x in first]
            key, at = np.concatenate(first), np.concatenate([np.arange(x) for x in k]).astype(np.int32)
            keep = met.have(key)
            yield pa.RecordBatch.from_arrays(
                [long_array(key[keep]), long_array(np.repeat(np.array(list(sets), np.uint64), k)[keep]),
                 pa.array(np.repeat([len(s) for s in sets.values()], k).astype(np.int32)[keep]), pa.array(at[keep])], names=["key", "u", "n", "p"])
    return run


def may_be_near(n, p, i, j):
    """Sizes, and what follows the shared element in both, allow a similarity of 0.8."""
    most = np.minimum(n[i] - p[i], n[j] - p[j])
    return (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])) & (9 * most >= 4 * (n[i] + n[j]))


def columns(batch: pa.RecordBatch, *names: str):
    """Arrays of 64-bit integers, one for each of ``names``, of every row's lists."""
    for row in zip(*(batch.column(c).to_pylist() for c in names)):
        yield [np.array(x, np.int64) for x in row]


def pair_batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def bucket_pairs(batches):
    """Pairs of a bucket that may be near copies and are not of one component."""
    for b in slices(batches):
        one, two = [], []
        for u, n, p, c in columns(b, "us", "ns", "ps", "cs"):
            i, j = np.triu_indices(len(u), 1)
            near = (c[i] != c[j]) & may_be_near(n, p, i, j)
            one.append(u[i[near]]), two.append(u[j[near]])
        yield pair_batch(one, two)


def next_pairs(batches):
    """Each set of a bucket with the next one by name that may be its near copy, of the next eight. In the
    many buckets of one group these are the same few pairs."""
    for b in slices(batches):
        one, two = [], []
        for u, n, p in columns(b, "us", "ns", "ps"):
            order = np.argsort(u)
            u, n, p = u[order], n[order], p[order]
            open_ = np.arange(len(u))
            for step in range(1, 9):
                i = open_[open_ < len(u) - step]
                near = may_be_near(n, p, i, i + step)
                one.append(u[i[near]]), two.append(u[i[near] + step])
                open_ = i[~near]
        yield pair_batch(one, two)


def part_pairs(batches):
    """The same for the sets at home in a part with all that came there, if not of one component."""
    for b in slices(batches):
        one, two = [], []
        for u, n, p, c, o in columns(b, "us", "ns", "ps", "cs", "os"):
            for i in np.flatnonzero(o):
                j = np.flatnonzero((c != c[i]) & may_be_near(n, p, i, np.arange(len(u))))
                one.append(np.repeat(u[i], len(j))), two.append(u[j])
        yield pair_batch(one, two)


def verify(width: int):
    """Pairs whose sets share 0.8 of their union."""
    def run(batches):
        for b in slices(batches, 64):
            keep, last, x = [], None, None
            for a, s, t in zip(b.column("a").to_pylist(), b.column("s").to_pylist(), b.column("t").to_pylist()):
                if a != last:
                    last, x = a, shingle_set(s, width)
                y = shingle_set(t, width)
                both = int((found(x, y) >= 0).sum())
                keep.append(5 * both >= 4 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def common_shingles(named: DataFrame, rows: int, width: int, often: int = 64, most: int = 200_000) -> np.ndarray:
    """Shingles that about ``often`` documents hold or more, from one document in 16 of a large
    table; the ``most`` most frequent. They only set the order, so the choice is free."""
    part = max(1, min(16, rows // 16384))
    sample = named.filter(F.pmod(F.xxhash64("uid"), F.lit(part)) == 0).select("text").mapInArrow(shingle_task(width), "key long")
    top = sample.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") >= max(4, often // part)).orderBy(F.desc("c"), "key").limit(most)
    return np.sort(np.array([r.key for r in top.select("key").collect()], np.int64).view(np.uint64))


def lists(*columns: str) -> list[F.Column]:
    return [F.collect_list(c).alias(f"{c}s") for c in columns]


def fingerprint_candidates(marked: DataFrame) -> DataFrame:
    """``a, b``: pairs of sets with equal or near fingerprints, of ``marked(u, f, ...)``; a fingerprint's smallest set stands for it."""
    first = cut(marked.groupBy("f").agg(F.min("u").alias("u")))
    same = marked.join(first.select("f", F.col("u").alias("a")), "f").filter("a <> u").select("a", F.col("u").alias("b"))
    near = (likely_links(first).join(first.select(F.col("f").alias("a"), F.col("u").alias("ua")), "a")
            .join(first.select(F.col("f").alias("b"), F.col("u").alias("ub")), "b"))
    return same.unionByName(near.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))).distinct()


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` that ``roots(u, root)`` does not connect."""
    for c in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("u").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    return pairs.filter("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")


def first_candidates(shared: DataFrame, bucket: int) -> DataFrame:
    """``a, b``: a few pairs a set that are likely near copies: neighbours in buckets of up to ``bucket``
    sets, and all pairs of the eights into which larger ones are dealt, twice."""
    light = shared.filter(F.col("size") <= bucket).groupBy("key").agg(*lists("u", "n", "p"))
    first = Window.partitionBy("u").orderBy("p")
    dense = (shared.filter(F.col("size") > bucket).withColumn("k", F.row_number().over(first)).filter("k <= 4")
             .withColumn("round", F.explode(F.array(F.lit(0), F.lit(1))))
             .withColumn("part", F.pmod(F.xxhash64("u", "key", "round"), F.ceil(F.col("size") / 8)))
             .withColumn("c", F.col("u")).groupBy("key", "round", "part").agg(*lists("u", "n", "p", "c")))
    near = light.select("us", "ns", "ps").mapInArrow(next_pairs, "a long, b long")
    return near.unionByName(dense.select("us", "ns", "ps", "cs").mapInArrow(bucket_pairs, "a long, b long")).distinct()


def light_candidates(shared: DataFrame, roots: DataFrame, bucket: int) -> DataFrame:
    """``a, b``: the pairs of buckets of up to ``bucket`` sets that ``roots(u, root)`` does not connect."""
    light = shared.filter(F.col("size") <= bucket).join(roots, "u", "left").withColumn("c", F.coalesce("root", "u"))
    lists_ = light.groupBy("key").agg(*lists("u", "n", "p", "c"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi")
    return lists_.select("us", "ns", "ps", "cs").mapInArrow(bucket_pairs, "a long, b long").distinct()


def candidates_across(dense: DataFrame, roots: DataFrame, bucket: int) -> DataFrame:
    """``a, b``: the pairs of large buckets that ``roots(u, root)`` does not connect.

    A bucket is dealt into parts. The sets outside its largest component go to all of them, so a
    group of near copies that is connected but for a few sets costs those few times the group.
    """
    rooted = cut(dense.join(roots, "u", "left").withColumn("c", F.coalesce("root", "u")).drop("root"))
    most = rooted.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("c", "m").alias("main"), F.count("*").alias("parts"))
    at = (rooted.join(most.filter("parts > 1"), "key").withColumn("g", F.ceil(F.col("size") / bucket).cast("int"))
          .withColumn("home", F.pmod(F.xxhash64("u"), "g").cast("int")))
    all_parts = F.when(F.col("c") == F.col("main"), F.array("home")).otherwise(F.sequence(F.lit(0), F.col("g") - 1))
    dealt = at.withColumn("part", F.explode(all_parts)).withColumn("o", F.col("part") == F.col("home"))
    return (dealt.groupBy("key", "part").agg(*lists("u", "n", "p", "c", "o")).select("us", "ns", "ps", "cs", "os")
            .mapInArrow(part_pairs, "a long, b long").distinct())


def verified(pairs: DataFrame, named: DataFrame, marked: DataFrame, width: int) -> DataFrame:
    """The pairs of a similarity of 0.8 or more. Texts of sets in pairs are fetched, one a set, and go
    to the pairs as texts, which pack better than sets of hashes."""
    pairs = cut(pairs)
    wanted = pairs.select(F.col("a").alias("u")).unionByName(pairs.select(F.col("b").alias("u"))).distinct()
    one = cut(marked.groupBy("u").agg(F.min("uid").alias("uid")).join(wanted, "u"))
    own = cuts()[-2:]
    texts = cut(named.select("uid", "text").join(one, "uid").dropDuplicates(["u"]).select("u", "text"))
    own.append(cuts()[-1])
    met = (pairs.join(texts.select(F.col("u").alias("a"), F.col("text").alias("s")), "a")
           .join(texts.select(F.col("u").alias("b"), F.col("text").alias("t")), "b"))
    out = cut(met.select("a", "b", "s", "t").mapInArrow(verify(width), "a long, b long"))
    drop_cuts(named.sparkSession, own)
    return out


def met_twice(named: DataFrame, common: np.ndarray, width: int):
    """Broadcast bits of the prefix elements that two texts hold; only these become rows."""
    words = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = min(24, max(8, (words >> 24).bit_length()))  # a fifth of the words, of some bytes each
    packed_ = named.select("text").mapInArrow(meeting_task(width, common, blocks), PACKED)
    often = cut(packed_.groupBy("block").applyInArrow(sum_block(2, blocks), "h long"))
    bits = bits_of(often, F.col("h"), often.count())
    drop_cuts(named.sparkSession, cuts()[-1:])
    return named.sparkSession.sparkContext.broadcast((bits.words, bits.size))


def roots_of(named: DataFrame, marked: DataFrame, width: int, bucket: int) -> DataFrame:
    """``u, root``: the group of each set that is not the smallest of its group.

    Pairs of near fingerprints are verified first, then likely ones by prefix; what these connect
    needs no other pair. Then come all pairs that are left, of smaller buckets and of larger ones.
    Tables go when they are read.
    """
    spark, before = named.sparkSession, cuts()
    named_roots = lambda links: cut(components(links).select(F.col("a").alias("u"), F.col("b").alias("root")))
    links = verified(fingerprint_candidates(marked), named, marked, width)
    drop_cuts(spark, [p for p in cuts()[:-1] if p not in before])
    known = named_roots(links)
    common = common_shingles(named, marked.count(), width)
    keyed = cut(named.select("text").mapInArrow(prefix_task(width, common, met_twice(named, common, width)), "key long, u long, n int, p int").distinct())
    own = cuts()[-1:]
    shared = cut(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "key"))
    drop_cuts(spark, own)
    links = links.unionByName(verified(apart(first_candidates(shared, bucket), known), named, marked, width))
    links = links.unionByName(verified(light_candidates(shared, named_roots(links), bucket), named, marked, width))
    roots = named_roots(links)
    dense = shared.filter(F.col("size") > bucket)
    if dense.isEmpty():
        return roots
    return named_roots(links.unionByName(verified(candidates_across(dense, roots, bucket), named, marked, width)))


def one_of_each(docs: DataFrame, width: int = 5, bucket: int = 256) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group of near copies: the smallest
    id that is not null, of equal ids one row.

    Texts are linked if the sets of their ``width``-word shingles have a Jaccard similarity of 0.8
    or more; linked texts and what is linked to them are one group. Null, empty and blank texts
    have no shingles and are one group. Equal sets are one node, whatever the order of their words'
    runs. Very long texts count whole. Rows repeated in id and text are one document and one of
    them stays. An empty table gives no rows; other columns stay, whatever their names.

    The rows to drop are few, so they are what the table is joined with; texts stay where they are.
    """
    spark = docs.sparkSession
    named = rekeyed(docs)
    marked = cut(named.mapInArrow(name_task(width), "uid binary, doc_id long, u long, f long"))
    first = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "uid")
    roots = roots_of(named, marked, width, bucket)
    rooted = marked.join(roots, "u", "left").select("uid", "doc_id", F.coalesce("root", "u").alias("root"))
    kept = cut(rooted.groupBy("root").agg(F.min(first).alias("first")).select("first.uid"))
    rows = marked.groupBy("uid").agg(F.count("*").alias("rows"))
    flags = cut(rows.join(kept.withColumn("kept", F.lit(True)), "uid", "left").filter("kept IS NULL OR rows > 1"))
    uid = free_name(docs, "uid")
    keyed = docs.withColumn(uid, row_key())
    single = keyed.join(flags.select(F.col("uid").alias(uid)), uid, "left_anti")
    again = keyed.join(flags.filter("kept").select(F.col("uid").alias(uid)), uid, "left_semi").dropDuplicates([uid])
    return single.unionByName(again).select(*docs.columns)
