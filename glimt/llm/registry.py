"""The queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glimt.llm import collocations, decontaminate, html_extract, language_id, mixing, nearest, negatives, quality_rules, secret_scan, sharding, simhash, suffix_dedup, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_html_extraction": html_extract.op3_html_extraction,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_mixing": mixing.op5_mixing,
        "op6_sharding": sharding.op6_sharding,
        "op7_secret_scan": secret_scan.op7_secret_scan,
        "op8_simhash": simhash.op8_simhash,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_language_id": language_id.op10_language_id,
        "op11_nearest": nearest.op11_nearest,
        "op12_hard_negatives": negatives.op12_hard_negatives,
        "op13_collocations": collocations.op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return url_filter.ORACLE | negatives.ORACLE | collocations.ORACLE
