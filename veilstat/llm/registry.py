"""Queries of the operators in this subpackage, by registered name."""

from __future__ import annotations

from veilstat.llm.chat_tree import op7_chat_prefix_tree
from veilstat.llm.decontamination import OP4_SQL, op4_decontamination
from veilstat.llm.kn_quality import op8_kn_quality
from veilstat.llm.line_dedup import op1_line_dedup
from veilstat.llm.mpeg_audio import op6_mpeg_audio
from veilstat.llm.packing import op3_best_fit_packing
from veilstat.llm.simhash_index import op9_simhash
from veilstat.llm.suffix_dedup import op10_suffix_dedup
from veilstat.llm.token_fst import op2_token_counts
from veilstat.llm.toxicity import op5_toxicity


def queries() -> dict:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_decontamination": op4_decontamination,
        "op5_toxicity": op5_toxicity,
        "op6_mpeg_audio": op6_mpeg_audio,
        "op7_chat_prefix_tree": op7_chat_prefix_tree,
        "op8_kn_quality": op8_kn_quality,
        "op9_simhash": op9_simhash,
        "op10_suffix_dedup": op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": OP4_SQL}
