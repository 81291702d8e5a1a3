"""Registered queries of the operators of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from .common import read_table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_secrets(spark, sf_dir):
    from .secrets import scan
    return scan(read_table(spark, sf_dir, "documents"))


def op2_quality(spark, sf_dir):
    from .quality import quality_report
    return quality_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_mixing(spark, sf_dir):
    from .mixing import mix_report
    return mix_report(read_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    from .substring_dedup import substring_report
    return substring_report(read_table(spark, sf_dir, "documents"))


def op5_ngram_join(spark, sf_dir):
    from .ngram_join import ngram_join
    return ngram_join(read_table(spark, sf_dir, "documents"))


def op6_packing(spark, sf_dir):
    from .packing import pack
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_html_extract(spark, sf_dir):
    from .html_extract import extract_report
    return extract_report(read_table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark, sf_dir):
    from .exact_dedup import dedup_report
    return dedup_report(read_table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    from .toxicity import toxicity_report
    return toxicity_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_embedding_dedup(spark, sf_dir):
    from .embedding_join import embedding_join
    return embedding_join(read_table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark, sf_dir):
    from .hard_negatives import mining_report
    return mining_report(read_table(spark, sf_dir, "embeddings"))


def op12_chat_format(spark, sf_dir):
    from .chat_format import chat_report, with_planted
    return chat_report(with_planted(read_table(spark, sf_dir, "conversations")))


def op13_alignment(spark, sf_dir):
    from .alignment import alignment_report
    return alignment_report(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                            tokenizer_path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_quality, op3_mixing, op4_substring_dedup, op5_ngram_join, op6_packing, op7_html_extract, op8_exact_dedup, op9_toxicity,
                                   op10_embedding_dedup, op11_hard_negatives, op12_chat_format, op13_alignment)}

ORACLE = {
    "op8_exact_dedup": """
        WITH g AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size
                   FROM documents GROUP BY 1)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept,
               sha256(coalesce(d.text, '')) AS text_sha256
        FROM documents d JOIN g ON coalesce(d.text, '') = g.t""",
}
