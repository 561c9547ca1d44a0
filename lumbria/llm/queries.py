"""The dealt operators as queries, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontaminate, exact_dedup, line_dedup, packing, periodic, setjoin, sharding, simhash, suffix_dedup, toxicity, url_filters, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_index": warc.op1_warc_index,
        "op2_template_tree": url_filters.op2_template_tree,
        "op3_two_stage_suffixes": suffix_dedup.op3_two_stage_suffixes,
        "op4_jump_shards": sharding.op4_jump_shards,
        "op5_simhash_pivots": simhash.op5_simhash_pivots,
        "op6_line_store": line_dedup.op6_line_store,
        "op7_phrase_index": decontaminate.op7_phrase_index,
        "op8_bin_slack": packing.op8_bin_slack,
        "op9_string_kernel": toxicity.op9_string_kernel,
        "op10_content_sort": exact_dedup.op10_content_sort,
        "op11_heavy_light": setjoin.op11_heavy_light,
        "op12_block_runs": periodic.op12_block_runs,
        "op13_group_dictionary": alignment.op13_group_dictionary,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_index": warc.SQL_OP1,
        "op6_line_store": line_dedup.SQL_OP6,
        "op7_phrase_index": decontaminate.SQL_OP7,
        "op10_content_sort": exact_dedup.SQL_OP10,
    }
