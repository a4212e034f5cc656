"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import align, bpe, covertree, hamming, jaccard, language, licenses, linededup, mixing, phrases, pii, secrets


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is; LACUNA_TOKENIZERS names another folder."""
    if folder := os.environ.get("LACUNA_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(documents(spark, sf_dir)))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_kept", F.length("text_out").cast("long").alias("n_chars_kept"), F.sha2("text_out", 256).alias("text_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op6_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = hamming.binary_codes(embeddings(spark, sf_dir))
    return hamming.top_k(codes, codes.where("vec_id % 100 = 0"), 10)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op8_bpe_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_stream(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), outputs=())


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_documents(documents(spark, sf_dir))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_links(embeddings(spark, sf_dir))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(documents(spark, sf_dir)))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_tokens(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_pii_weak_supervision, op3_line_dedup, op4_language_id, op5_token_counts, op6_hamming_top_k, op7_secret_scan, op8_bpe_streaming, op9_ngram_jaccard, op10_embedding_near_dedup, op11_license_scan, op12_tokenizer_alignment, op13_phrase_collocations)}

ORACLE_SQL = {
    "op6_hamming_top_k": """
        WITH bits AS (
            SELECT vec_id, i, embedding[i] > 0 AS b
            FROM embeddings, (SELECT unnest(range(1, 65)) AS i)
            WHERE embedding IS NOT NULL AND len(embedding) = 64),
        d AS (
            SELECT q.vec_id AS query_id, a.vec_id AS vec_id, CAST(count(*) FILTER (WHERE q.b <> a.b) AS INTEGER) AS distance
            FROM bits q JOIN bits a ON q.i = a.i AND q.vec_id <> a.vec_id
            WHERE q.vec_id % 100 = 0
            GROUP BY 1, 2),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d)
        SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10""",
    "op9_ngram_jaccard": r"""
        WITH RECURSIVE t AS (
            SELECT doc_id, string_split_regex(trim(lower(coalesce(text, '')), E' \n\t\r'), '\s+') AS ws FROM documents),
        w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM t),
        g AS (
            SELECT doc_id, i, n, word || chr(1) || coalesce(lead(word, 1) OVER o, '') || chr(1) || coalesce(lead(word, 2) OVER o, '') || chr(1) || coalesce(lead(word, 3) OVER o, '') || chr(1) || coalesce(lead(word, 4) OVER o, '') AS s
            FROM w WHERE word <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        s AS (SELECT DISTINCT doc_id, s FROM g WHERE i <= greatest(1, n - 4)),
        size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (
            SELECT a, b FROM both_ JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
            WHERE c >= 0.8::DOUBLE * (x.n + y.n - c) - 1e-9),
        r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON r.v = l.a),
        k AS (SELECT v, min(c) AS class_id FROM r GROUP BY 1)
        SELECT d.doc_id, k.class_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links, k.class_id = d.doc_id AS kept
        FROM documents d JOIN k ON k.v = d.doc_id""",
    "op10_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        r AS (SELECT vec_id AS n, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.n = l.a),
        k AS (SELECT n, min(c) AS component_id FROM r GROUP BY 1)
        SELECT x.vec_id, (SELECT count(*) FROM l WHERE l.a = x.vec_id) AS n_links, k.component_id, k.component_id = x.vec_id AS kept
        FROM embeddings x JOIN k ON k.n = x.vec_id""",
    "op13_phrase_collocations": r"""
        WITH t AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece
            FROM documents),
        p AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM t),
        i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
        g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM i, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(ws)),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
        c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
        parts AS (
            SELECT c.lang, c.k, c.phrase, c.a, c.ws, cut, array_to_string(ws[1 : cut], ' ') AS head, array_to_string(ws[cut + 1 :], ' ') AS rest
            FROM c, (SELECT unnest([1, 2]) AS cut) WHERE cut < c.k),
        s AS (
            SELECT parts.*, x.a AS l, y.a AS r, CAST(1000000::HUGEINT * parts.a * parts.a // (x.a::HUGEINT * y.a) AS BIGINT) AS score
            FROM parts JOIN f x ON x.lang = parts.lang AND x.phrase = head AND x.k = cut JOIN f y ON y.lang = parts.lang AND y.phrase = rest AND y.k = parts.k - cut
            QUALIFY row_number() OVER (PARTITION BY parts.lang, parts.phrase ORDER BY score, cut) = 1),
        inner_ AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
        gone AS (SELECT DISTINCT s.lang, s.phrase FROM s JOIN inner_ ON inner_.lang = s.lang AND inner_.phrase = s.phrase WHERE s.k = 2 AND 100 * inner_.a >= 50 * s.a),
        n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1)
        SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, l, r, n.n, score
        FROM s JOIN n ON n.lang = s.lang WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.lang = s.lang AND gone.phrase = s.phrase)
        QUALIFY rank <= 2000""",
}
