"""Queries of this subpackage, by the name they are registered under."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cells, licenses, minhash, mixing, packing, pii, quality, substrings, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_tiled_topk": topk.op1_tiled_topk,
        "op2_chained_passages": substrings.op2_chained_passages,
        "op3_cell_dedup": cells.op3_cell_dedup,
        "op4_ordinal_quality": quality.op4_ordinal_quality,
        "op5_pareto_mix": mixing.op5_pareto_mix,
        "op6_license_join": licenses.op6_license_join,
        "op7_pii_boosted": pii.op7_pii_boosted,
        "op8_length_buckets": packing.op8_length_buckets,
        "op9_gru_toxicity": toxicity.op9_gru_toxicity,
        "op10_minhash_dedup": minhash.op10_minhash_dedup,
        # what SQL can say of operators whose whole result it can't
        "pii_base_spans": pii.base_spans,
        "bucket_padding": packing.padding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_tiled_topk": topk.ORACLE,
        "op3_cell_dedup": cells.ORACLE,
        "op5_pareto_mix": mixing.ORACLE,
        "op6_license_join": licenses.ORACLE,
        "op10_minhash_dedup": minhash.ORACLE,
        "pii_base_spans": pii.BASE_SQL,
        "bucket_padding": packing.PADDING_SQL,
    }
