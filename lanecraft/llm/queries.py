"""The registered queries of the corpus operators and the SQL that says the same."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codebooks, exact, fill_middle, id_files, jpeg, mixing, pages, passages, pieces, secrets, simhash, toxicity
from .common import checkpoint_dir, read


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(read(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(read(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.without_repeats(read(spark, sf_dir, "documents"), kept_bytes=False).drop("_row")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents")).drop("_row")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.features(read(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compressed(read(spark, sf_dir, "embeddings"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(read(spark, sf_dir, "documents"))


def op13_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files stay in the shared folder, as the result is read from them."""
    path = f"{checkpoint_dir(spark)}/id-files-{uuid.uuid4().hex}"
    return id_files.digests(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_secrets, op3_main_text, op4_mixing, op5_toxicity, op6_passages, op7_simhash, op8_token_counts, op9_jpeg, op10_byte_bpe, op11_vector_codes, op12_fill_middle, op13_id_files)}
ROUNDS = 4


def _vector_codes() -> str:
    """Rounds of assigning parts to entries and averaging, written out one after another."""
    nearest = """a{k} AS (
        SELECT vec_id, p, any_value(q) AS q, min({{'d': qq + cc - 2 * list_inner_product(q, c), 'e': e}}) AS b FROM parts JOIN c{k} USING (p) GROUP BY vec_id, p
    )"""
    means = """m{k} AS (
        SELECT p, e, list(m ORDER BY i) AS c FROM (
            SELECT p, b.e AS e, i, floor(sum(q[i]) / count(*)) AS m FROM a{k}, width, range(1, w + 1) r(i) GROUP BY p, b.e, i
        ) GROUP BY p, e
    ), c{n} AS (
        SELECT p, e, coalesce(m{k}.c, c{k}.c) AS c, list_inner_product(coalesce(m{k}.c, c{k}.c), coalesce(m{k}.c, c{k}.c)) AS cc FROM c{k} LEFT JOIN m{k} USING (p, e)
    )"""
    steps = [step.format(k=k, n=k + 1) for k in range(ROUNDS) for step in (nearest, means)] + [nearest.format(k=ROUNDS)]
    return f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), width AS (SELECT any_value(len(v)) // 4 AS w FROM kept),
        parts AS (SELECT vec_id, p, v[p * w + 1:(p + 1) * w] AS q, list_inner_product(v[p * w + 1:(p + 1) * w], v[p * w + 1:(p + 1) * w]) AS qq FROM kept, width, range(4) r(p)),
        c0 AS (
            SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, q AS c, qq AS cc FROM parts
            WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)
        ), {", ".join(steps)},
        codes AS (SELECT vec_id, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM c{ROUNDS})) AS codebooks_sha256
        FROM codes JOIN kept USING (vec_id)
    """


ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
            FROM documents
        ), g AS (
            SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY plain) AS group_size
            FROM d WINDOW w AS (PARTITION BY plain ORDER BY chars DESC, doc_id NULLS LAST)
        )
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(plain) AS text_sha256 FROM g
    """,
    "op11_vector_codes": _vector_codes(),
    "op12_fill_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, list_transform(regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), lambda u: length(u)) AS units,
                sha256('42:' || doc_id) AS h
            FROM documents
        ), h AS (
            SELECT *, len(units) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS r FROM d
        ), c AS (
            SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM h
        ), o AS (
            SELECT *, CAST(coalesce(list_sum(units[1:a]), 0) AS BIGINT) AS first, CAST(coalesce(list_sum(units[1:b]), 0) AS BIGINT) AS last FROM c
        ), p AS (
            SELECT *, substr(text, 1, first) AS prefix, substr(text, first + 1, last - first) AS middle, substr(text, last + 1) AS suffix FROM o
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN first END AS prefix_chars, CASE WHEN form <> 'plain' THEN last - first END AS middle_chars,
            sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM p
    """,
}
