"""Registered queries of this package and their SQL."""

from __future__ import annotations

from marlstone.llm.decontamination import OP4_SQL, op4_spaced_seeds
from marlstone.llm.embedding_whitening import op13_whitening_svd
from marlstone.llm.filter_audit import OP11_SQL, op11_filter_audit
from marlstone.llm.html_extraction import op1_tag_path_ratios
from marlstone.llm.mixing import OP8_SQL, op8_hierarchical_mixing
from marlstone.llm.pii_boosting import op3_pii_boosted
from marlstone.llm.quality_rules import OP9_SQL, op9_quality_rules
from marlstone.llm.secret_ownership import op6_secret_ownership
from marlstone.llm.simhash_neardup import op7_simhash_pigeonring
from marlstone.llm.substring_dedup import OP5_SQL, op5_relative_lempel_ziv
from marlstone.llm.token_counts import op2_token_counts
from marlstone.llm.token_files import op10_repair_token_files
from marlstone.llm.toxicity import op12_noisy_channel

QUERIES = {
    "op1_tag_path_ratios": op1_tag_path_ratios,
    "op2_token_counts": op2_token_counts,
    "op3_pii_boosted": op3_pii_boosted,
    "op4_spaced_seeds": op4_spaced_seeds,
    "op5_relative_lempel_ziv": op5_relative_lempel_ziv,
    "op6_secret_ownership": op6_secret_ownership,
    "op7_simhash_pigeonring": op7_simhash_pigeonring,
    "op8_hierarchical_mixing": op8_hierarchical_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_repair_token_files": op10_repair_token_files,
    "op11_filter_audit": op11_filter_audit,
    "op12_noisy_channel": op12_noisy_channel,
    "op13_whitening_svd": op13_whitening_svd,
}
ORACLE_SQL = {
    "op4_spaced_seeds": OP4_SQL,
    "op5_relative_lempel_ziv": OP5_SQL,
    "op8_hierarchical_mixing": OP8_SQL,
    "op9_quality_rules": OP9_SQL,
    "op11_filter_audit": OP11_SQL,
}
