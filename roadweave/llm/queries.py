"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, clusters, exact_dedup, html_text, importance, mixing, ngram_join, packing, quality, suffix_dedup, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_ngram_join": ngram_join.op3_ngram_join,
        "op4_nearest": ann.op4_nearest,
        "op5_quality": quality.op5_quality,
        "op6_warc": warc.op6_warc,
        "op7_packing": packing.op7_packing,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_html_extraction": html_text.op9_html_extraction,
        "op10_byte_bpe": bpe.op10_byte_bpe,
        "op11_importance_resampling": importance.op11_importance_resampling,
        "op12_centroid_clusters": clusters.op12_centroid_clusters,
        "op13_source_mixing": mixing.op13_source_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.oracle_sql(),
        "op6_warc": warc.oracle_sql(),
        "op8_url_filter": url_filter.oracle_sql(),
        "op11_importance_resampling": importance.oracle_sql(),
        "op12_centroid_clusters": clusters.oracle_sql(),
    }
