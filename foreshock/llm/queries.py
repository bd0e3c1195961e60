"""Registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foreshock.llm.chat import ORACLE_OP5, op5_fingerprint_chat
from foreshock.llm.decontaminate import ORACLE_OP10, op10_template_decontamination
from foreshock.llm.katz import op9_katz_backoff
from foreshock.llm.licenses import op3_dice_licenses
from foreshock.llm.merkle import ORACLE_OP12, op12_merkle_manifest
from foreshock.llm.mixing import ORACLE_OP2, op2_pareto_mix
from foreshock.llm.near_dup import ORACLE_OP4, op4_min_max_near_duplicates
from foreshock.llm.quality_model import op8_boosted_quality
from foreshock.llm.quality_rules import ORACLE_OP6, op6_repetition_coverage
from foreshock.llm.secrets import op7_guess_cost_secrets
from foreshock.llm.simhash import op11_simhash_multi_index
from foreshock.llm.toxicity import op1_ordinal_toxicity
from foreshock.llm.whitening import op13_whitened_embeddings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ordinal_toxicity": op1_ordinal_toxicity,
    "op2_pareto_mix": op2_pareto_mix,
    "op3_dice_licenses": op3_dice_licenses,
    "op4_min_max_near_duplicates": op4_min_max_near_duplicates,
    "op5_fingerprint_chat": op5_fingerprint_chat,
    "op6_repetition_coverage": op6_repetition_coverage,
    "op7_guess_cost_secrets": op7_guess_cost_secrets,
    "op8_boosted_quality": op8_boosted_quality,
    "op9_katz_backoff": op9_katz_backoff,
    "op10_template_decontamination": op10_template_decontamination,
    "op11_simhash_multi_index": op11_simhash_multi_index,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_whitened_embeddings": op13_whitened_embeddings,
}

ORACLES: dict[str, str] = {
    "op2_pareto_mix": ORACLE_OP2,
    "op4_min_max_near_duplicates": ORACLE_OP4,
    "op5_fingerprint_chat": ORACLE_OP5,
    "op6_repetition_coverage": ORACLE_OP6,
    "op10_template_decontamination": ORACLE_OP10,
    "op12_merkle_manifest": ORACLE_OP12,
}
