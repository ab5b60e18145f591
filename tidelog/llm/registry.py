"""Queries of the training-data operators, and their DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, divergence, exact, imatch, inner_product, language_model, lexical, lines, near, packing, quality, token_files, toxicity
from tidelog.llm.common import documents, embeddings, labels


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, as the package that brings them names it on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.likelihoods(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    return coded.select("doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_documents(documents(spark, sf_dir))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.deduplicate_lines(documents(spark, sf_dir))
    return left.select("doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.char_length("text").cast("long").alias("left_chars"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("left_sha256"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_product.top_products(embeddings(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice_lm": op1_lattice_lm,
    "op2_bpe": op2_bpe,
    "op3_packing": op3_packing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality": op5_quality,
    "op6_token_files": op6_token_files,
    "op7_imatch": op7_imatch,
    "op8_near_dedup": op8_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_line_chunks": op10_line_chunks,
    "op11_divergence": op11_divergence,
    "op12_lexical_search": op12_lexical_search,
    "op13_top_products": op13_top_products,
}

ORACLE: dict[str, str] = {
    "op4_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, n.text_sha256 FROM n JOIN g USING (text_sha256)
""",
    "op11_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row_no, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row_no) >= 30),
counted AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, term, CAST(sum(c) AS BIGINT) AS c FROM counted GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT g.lang, g.source, k.term, coalesce(x.c, 0) AS c FROM grp g JOIN kept k USING (lang) LEFT JOIN counted x USING (lang, source, term)),
sums AS (SELECT lang, source, CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM cells GROUP BY ALL),
lang_sums AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM langs GROUP BY ALL),
p AS (SELECT lang, source, term, c, 1 + (1000000000 * CAST(c + 5 AS HUGEINT)) // (n + 5 * v) AS p FROM cells JOIN sums USING (lang, source)),
q AS (SELECT lang, term, 1 + (1000000000 * CAST(c + 5 AS HUGEINT)) // (n + 5 * v) AS q FROM langs JOIN lang_sums USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY ALL),
all_pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
""",
    "op12_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT row_no, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT row_no, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY row_no),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
part AS (SELECT item_id, row_no, doc_id, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n.n * docs) // words))) AS x
    FROM item JOIN weight USING (term) JOIN tf USING (term) JOIN n USING (row_no), total),
score AS (SELECT item_id, row_no, doc_id, CAST(sum(x) AS BIGINT) AS score FROM part GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
""",
    "op13_top_products": r"""
WITH v AS (SELECT row_number() OVER () AS row_no, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.row_no, q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)]) AS BIGINT) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
""",
}
