"""What the entry module registers: queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import bpe, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, packing, ranked_search, secret_scan, sharding, spelling, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_packing": packing.op3_packing,
        "op4_language_id": language_id.op4_language_id,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_jaccard_join": jaccard_join.op7_jaccard_join,
        "op8_sharding": sharding.op8_sharding,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_secret_scan": secret_scan.op10_secret_scan,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_ranked_search": ranked_search.op12_ranked_search,
        "op13_bpe": bpe.op13_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.OP1_SQL, "op6_url_filter": url_filter.OP6_SQL, "op11_spelling_variants": spelling.OP11_SQL, "op12_ranked_search": ranked_search.OP12_SQL}
