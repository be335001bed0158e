"""Queries of the corpus operators, each over the whole of its table, and their SQL where SQL can say it."""

from __future__ import annotations

from .common import table
from . import ann, bin_packing, byte_bpe, embedding_dedup, language_id, periodic_runs, pii, quality, target_resampling, token_rollup, url_filter
from .minhash_dedup import near_duplicates
from .packing import pack


def op1_token_rollup(spark, sf_dir):
    return token_rollup.history(spark, sf_dir)


def op2_pii(spark, sf_dir):
    return pii.find(spark, table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op4_minhash_dedup(spark, sf_dir):
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op5_quality(spark, sf_dir):
    return quality.scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_byte_bpe(spark, sf_dir):
    return byte_bpe.encode_decode(spark, table(spark, sf_dir, "documents"))


def op7_url_filter(spark, sf_dir):
    return url_filter.judge(spark, table(spark, sf_dir, "pages"))


def op8_language_id(spark, sf_dir):
    return language_id.predictions(spark, table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    return pack(spark, table(spark, sf_dir, "documents"))


def op10_ann(spark, sf_dir):
    return ann.neighbours(spark, table(spark, sf_dir, "embeddings"))


def op11_bin_packing(spark, sf_dir):
    return bin_packing.pack(spark, table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark, sf_dir):
    return periodic_runs.report(spark, table(spark, sf_dir, "documents"))


def op13_target_resampling(spark, sf_dir):
    return target_resampling.draw(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_token_rollup": op1_token_rollup,
    "op2_pii": op2_pii,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_quality": op5_quality,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_url_filter": op7_url_filter,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_ann": op10_ann,
    "op11_bin_packing": op11_bin_packing,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_target_resampling": op13_target_resampling,
}
ORACLE: dict[str, str] = {"op1_token_rollup": token_rollup.ORACLE, "op13_target_resampling": target_resampling.ORACLE}
