"""Queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsquant.llm.chat_events import chat_rows
from newsquant.llm.context_mixing import lm_rows
from newsquant.llm.decision_lists import quality_rows
from newsquant.llm.entropy_secrets import secret_rows
from newsquant.llm.keyed_shards import shard_rows
from newsquant.llm.lpf_dedup import repeat_rows
from newsquant.llm.piece_lattice import piece_rows
from newsquant.llm.simhash_slices import simhash_rows
from newsquant.llm.template_leaks import leak_rows
from newsquant.llm.token_counts import token_rows
from newsquant.llm.turn_repair import repair_rows
from newsquant.llm.vector_codes import code_rows
from newsquant.llm.warc_zstd import warc_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_context_mixing": lm_rows,
    "op2_template_leaks": leak_rows,
    "op3_token_counts": token_rows,
    "op4_decision_lists": quality_rows,
    "op5_piece_lattice": piece_rows,
    "op6_warc_zstd": warc_rows,
    "op7_chat_events": chat_rows,
    "op8_entropy_secrets": secret_rows,
    "op9_lpf_dedup": repeat_rows,
    "op10_simhash_slices": simhash_rows,
    "op11_turn_repair": repair_rows,
    "op12_keyed_shards": shard_rows,
    "op13_equal_average": code_rows,
}

ORACLES: dict[str, str] = {}
