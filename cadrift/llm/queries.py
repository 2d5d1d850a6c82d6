"""The operators over the given tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadrift.llm import bpe, collocations, decontaminate, divergence, embeddings, lines, pii, ppm, quality, sharding, simhash, substrings, token_files
from cadrift.llm.common import table
from cadrift.session import checkpoint_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_token_files")
def op1_token_files(spark, d):
    path = f"{checkpoint_root(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, d, "documents"), path)
    return token_files.token_digest(spark, path)


@query("op4_sharding")
def op4_sharding(spark, d):
    out = sharding.assign_shards(table(spark, d, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op8_line_dedup", f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '{UPPER}', '{LOWER}') AS k FROM lines),
shared AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keyed.*, first IS NOT NULL AND first <> doc_id AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op8_line_dedup(spark, d):
    return lines.dedup_lines(table(spark, d, "documents"), digest=True).select("doc_id", "n_lines", "n_dropped", F.col("kept").alias("kept_sha256"))


@query("op2_simhash")
def op2_simhash(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents"))


@query("op6_quality")
def op6_quality(spark, d):
    docs = table(spark, d, "documents")
    weights = quality.train(docs, table(spark, d, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", (quality.fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query("op3_bpe")
def op3_bpe(spark, d):
    return bpe.encode(table(spark, d, "documents"), ("n_tokens", "ids_sha256", "decoded_sha256"))


@query("op7_ppm")
def op7_ppm(spark, d):
    return ppm.score_texts(table(spark, d, "documents"))


@query("op5_substrings")
def op5_substrings(spark, d):
    return substrings.remove_repeats(table(spark, d, "documents"), digest=True).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


@query("op10_decontaminate")
def op10_decontaminate(spark, d):
    return decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op9_embeddings")
def op9_embeddings(spark, d):
    return embeddings.near_vectors(table(spark, d, "embeddings"))


@query("op11_divergence", f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
listed AS (SELECT doc, lang, source, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM d),
by_doc AS (SELECT doc, lang, source, w AS term, count(*) AS n FROM (SELECT doc, lang, source, unnest(w) AS w FROM listed) GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM by_doc GROUP BY lang, term HAVING count(*) >= 3),
groups AS (SELECT DISTINCT lang, source FROM d),
counted AS (SELECT lang, source, term, CAST(sum(by_doc.n) AS HUGEINT) AS n FROM by_doc SEMI JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT g.lang, g.source, coalesce(t.total, 0) AS total, coalesce(k.v, 0) AS v, coalesce(k.total, 0) AS all_total FROM groups g
         LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counted GROUP BY ALL) t USING (lang, source)
         LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang) k USING (lang)),
shares AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
                  1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // CAST(s.total + s.v AS HUGEINT) AS p,
                  1 + CAST(1000000000 AS HUGEINT) * (k.n + 1) // CAST(s.all_total + s.v AS HUGEINT) AS q
           FROM size s JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
          FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
          UNION ALL SELECT a.lang, a.source, b.source, 0 FROM size a JOIN size b ON b.lang = a.lang AND b.source <> a.source WHERE a.v = 0),
terms AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
           UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank
                                    FROM terms) WHERE rank <= 200)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked""")
def op11_divergence(spark, d):
    return divergence.source_divergence(table(spark, d, "documents"))


@query("op12_personal_data")
def op12_personal_data(spark, d):
    return pii.find_personal_data(table(spark, d, "documents"))


@query("op13_collocations", f"""
WITH pieces AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(parts) AS piece, unnest(range(len(parts))) AS pos
                FROM (SELECT row_number() OVER () AS doc_id, lang,
                             regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]') AS parts FROM documents)),
listed AS (SELECT doc_id, pos, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
words AS (SELECT doc_id, pos, lang, unnest(w) AS w1, unnest(range(len(w))) AS i FROM listed),
runs AS (SELECT lang, w1, lead(w1, 1) OVER piece AS w2, lead(w1, 2) OVER piece AS w3 FROM words WINDOW piece AS (PARTITION BY doc_id, pos ORDER BY i)),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS n FROM runs GROUP BY ALL HAVING count(*) >= 10),
f2 AS (SELECT lang, w1, w2, count(*) AS n FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS n FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (SELECT c.lang, w1, w2, NULL AS w3, c.n AS a, 1 AS k, x.n AS l, y.n AS r
         FROM f2 c JOIN f1 x USING (lang, w1) JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2
         UNION ALL SELECT c.lang, c.w1, c.w2, c.w3, c.n, 1, x.n, y.n
         FROM f3 c JOIN f1 x USING (lang, w1) JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
         UNION ALL SELECT c.lang, c.w1, c.w2, c.w3, c.n, 2, x.n, y.n
         FROM f3 c JOIN f2 x USING (lang, w1, w2) JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w3),
scored AS (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w1, w2, w3 ORDER BY score, k) = 1),
around AS (SELECT lang, w1, w2, max(n) AS fl FROM (SELECT lang, w1, w2, n FROM f3 UNION ALL SELECT lang, w2, w3, n FROM f3) GROUP BY lang, w1, w2),
kept AS (SELECT best.*, concat_ws(' ', w1, w2, w3) AS phrase FROM best LEFT JOIN around USING (lang, w1, w2)
         WHERE w3 IS NOT NULL OR fl IS NULL OR 100 * fl < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""")
def op13_collocations(spark, d):
    return collocations.collocations(table(spark, d, "documents"))
