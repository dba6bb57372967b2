"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import (
    bpe,
    collocations,
    decontamination,
    language_id,
    lsh_forest,
    quality,
    secret_scan,
    token_tables,
    toxicity,
    url_filter,
    vector_codes,
    warc,
    winnowing,
)
from tidemill.llm.common import id_remainder, literal_rows, read_table, written

#: The rules that the URL query applies (fixed values): host, path, verdict.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
    model = language_id.fit(docs.where(~held_out))
    judged = language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return judged.select("doc_id", "held_out", "lang_pred", "score")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(read_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.k + y.k - m)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT b, c FROM r JOIN both_ways ON a = r.doc_id)
SELECT w.doc_id, coalesce(n.k, 0) AS n_shingles, min(c) AS component_id, min(c) = w.doc_id AS kept
FROM w JOIN r ON r.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id, n.k
"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(spark, read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a test item, with the items."""
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_tables.round_trip(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = literal_rows(spark, URL_RULES, ["host", "path", "verdict"], ["string"] * 3)
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), rules)


OP6_SQL = """
WITH r(rh, rp, rv) AS (VALUES ('com','/en/','block'), ('example.com','/en/7','allow'), ('net','/de/','block'),
                              ('example.net','/de/8','block'), ('org','/es/','block')),
u AS (SELECT row_number() OVER () AS k, page_id,
        CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT k, page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT k, rh || rp AS rule, rv, row_number() OVER (PARTITION BY k ORDER BY -length(rh || rp), rh || rp, rv) AS n
      FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM p LEFT JOIN m ON p.k = m.k AND n = 1
"""


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_edits(read_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scanned = secret_scan.scan(docs.select("doc_id", "text"), secret_scan.fit(docs))
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, read_table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    # measured once, for learning and for scores: a table of thirteen numbers a document
    measured = written(quality.with_statistics(docs), "op10-statistics")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    learned = labels.where(id_remainder("doc_id", 5) != 0)
    model = quality.fit(measured.join(learned, measured["id"] == learned["doc_id"]))
    scored = quality.score(measured.withColumnRenamed("id", "doc_id"), model)
    return scored.select(
        "doc_id",
        F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(id_remainder("doc_id", 4) != 2)
    scored = toxicity.judged(docs, toxicity.fit(docs, labels), keep=["doc_id"])
    return scored.select(
        "doc_id",
        F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
        "spans",
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM d),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, ws, i, unnest([1, 2, 3]) AS m FROM s),
f AS MATERIALIZED (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS c FROM g WHERE i + m - 1 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
c AS MATERIALIZED (SELECT lang, m, phrase, c AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND c >= 10),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
b AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:m], ' ') AS rp FROM k),
cut AS (SELECT b.lang, b.phrase, a, k, x.c AS l, y.c AS r, (1000000::HUGEINT * a * a) // (x.c::HUGEINT * y.c) AS score
        FROM b JOIN f x ON x.lang = b.lang AND x.phrase = lp JOIN f y ON y.lang = b.lang AND y.phrase = rp),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE m = 3),
most AS (SELECT lang, phrase, max(a) AS b FROM inner_ GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN most ON most.lang = best.lang AND most.phrase = best.phrase WHERE b IS NULL OR 100 * b < 50 * best.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= 2000
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(read_table(spark, sf_dir, "embeddings"))
    digest = F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256")
    coded = vector_codes.with_label_errors(codes)
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", digest)


OP13_SQL = """
WITH v AS (SELECT row_number() OVER () AS i, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT i, part, x[part * (len(x) // 16) + 1:(part + 1) * (len(x) // 16)] AS x FROM v, (SELECT unnest(range(16)) AS part)),
f AS (SELECT i, row_number() OVER (ORDER BY vec_id, x) - 1 AS e FROM v QUALIFY e < 64),
b0 AS (SELECT part, e, x FROM p JOIN f USING (i)),
a1 AS (SELECT p.i, p.part, any_value(p.x) AS x, min({'d': list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}) AS n
       FROM p JOIN b0 b USING (part) GROUP BY 1, 2),
s1 AS (SELECT part, n.e AS e, j, sum(x[j])::BIGINT AS s, count(*) AS c FROM a1, unnest(range(1, len(x) + 1)) AS t(j) GROUP BY ALL),
m1 AS (SELECT part, e, list((s - ((s % c + c) % c)) // c ORDER BY j) AS x FROM s1 GROUP BY 1, 2),
b1 AS (SELECT b0.part, b0.e, coalesce(m1.x, b0.x) AS x FROM b0 LEFT JOIN m1 ON m1.part = b0.part AND m1.e = b0.e),
a2 AS (SELECT p.i, p.part, any_value(p.x) AS x, min({'d': list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}) AS n
       FROM p JOIN b1 b USING (part) GROUP BY 1, 2),
s2 AS (SELECT part, n.e AS e, j, sum(x[j])::BIGINT AS s, count(*) AS c FROM a2, unnest(range(1, len(x) + 1)) AS t(j) GROUP BY ALL),
m2 AS (SELECT part, e, list((s - ((s % c + c) % c)) // c ORDER BY j) AS x FROM s2 GROUP BY 1, 2),
b2 AS (SELECT b1.part, b1.e, coalesce(m2.x, b1.x) AS x FROM b1 LEFT JOIN m2 ON m2.part = b1.part AND m2.e = b1.e),
a3 AS (SELECT p.i, p.part, min({'d': list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}) AS n
       FROM p JOIN b2 b USING (part) GROUP BY 1, 2),
r AS (SELECT i, string_agg(printf('%02x', n.e), '' ORDER BY part) AS code, sum(n.d)::BIGINT AS error FROM a3 GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS digest FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256
FROM r JOIN v USING (i), h
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_bpe": op3_bpe,
    "op4_decontamination": op4_decontamination,
    "op5_token_tables": op5_token_tables,
    "op6_url_filter": op6_url_filter,
    "op7_winnowing": op7_winnowing,
    "op8_secret_scan": op8_secret_scan,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
    "op11_toxicity": op11_toxicity,
    "op12_collocations": op12_collocations,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES: dict[str, str] = {"op2_near_duplicates": OP2_SQL, "op6_url_filter": OP6_SQL, "op12_collocations": OP12_SQL, "op13_vector_codes": OP13_SQL}
