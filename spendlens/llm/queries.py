"""The corpus operators bound to the test tables: one query for each, with production parameters."""

from __future__ import annotations

import corpus_pipeline
from spendlens.llm import chat, decontaminate, divergence, fingerprint, html_text, licenses, lines, lm_score, mixing, neardup, search, sharding, toxicity
from spendlens.llm.common import table


def op1_bagminhash_neardup(spark, sf_dir):
    return neardup.classify(table(spark, sf_dir, "documents"), stored=True)


def op2_ftrl_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, table(spark, sf_dir, "labels"))


def op3_crf_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op4_simhash_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.deduplicate(docs, stored=True, tables=lines.TABLES)


def op5_iblt_fingerprints(spark, sf_dir):
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_backoff_lm_score(spark, sf_dir):
    return lm_score.score(table(spark, sf_dir, "documents"), stored=True)


def op7_suffix_array_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"]))


def op8_dice_licence_scan(spark, sf_dir):
    return licenses.best(licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]), keep=["licences"])


def op9_hypergeometric_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op10_pivotal_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, keep=["doc_id", "source"], stored=True).select(
        "doc_id", "source", "size", "source_size", "target", "copies", "taken"
    )


def op11_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_geometric_block_search(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_incremental_chat_format(spark, sf_dir):
    chats = chat.with_planted(table(spark, sf_dir, "conversations"))
    return chat.digest(chat.format_chats(chats))


def queries() -> dict:
    operators = (
        op1_bagminhash_neardup, op2_ftrl_toxicity, op3_crf_html_text, op4_simhash_line_dedup, op5_iblt_fingerprints,
        op6_backoff_lm_score, op7_suffix_array_decontamination, op8_dice_licence_scan, op9_hypergeometric_sharding,
        op10_pivotal_mixing, op11_source_divergence,
        op12_geometric_block_search, op13_incremental_chat_format,
    )
    return {fn.__name__: fn for fn in operators} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Twins of the queries that SQL can express; the others are tested against brute force."""
    return {
        "op1_bagminhash_neardup": neardup.ORACLE, "op7_suffix_array_decontamination": decontaminate.ORACLE,
        "op11_source_divergence": divergence.ORACLE, "op12_geometric_block_search": search.ORACLE,
        "op13_incremental_chat_format": chat.ORACLE,
    }
