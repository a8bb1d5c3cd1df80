"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .checks import OP1_SQL, OP4_SQL, OP5_SQL
from .op1_jaccard import op1_jaccard
from .op2_suffix_array import op2_suffix_array
from .op3_quality import op3_quality
from .op4_decontaminate import op4_decontaminate
from .op5_substring import op5_substring
from .op6_mix import OP6_SQL, op6_mix
from .op7_lm import op7_lm
from .op8_lines import OP8_SQL, op8_lines
from .op9_secrets import op9_secrets
from .op10_embeddings import op10_embeddings
from .op11_negatives import OP11_SQL, op11_negatives
from .op12_shards import op12_shards
from .op13_trie import OP13_SQL, op13_trie


def llm_queries() -> dict:
    return {
        "op1_jaccard": op1_jaccard,
        "op2_suffix_array": op2_suffix_array,
        "op3_quality": op3_quality,
        "op4_decontaminate": op4_decontaminate,
        "op5_substring": op5_substring,
        "op6_mix": op6_mix,
        "op7_lm": op7_lm,
        "op8_lines": op8_lines,
        "op9_secrets": op9_secrets,
        "op10_embeddings": op10_embeddings,
        "op11_negatives": op11_negatives,
        "op12_shards": op12_shards,
        "op13_trie": op13_trie,
    }


def llm_oracle_sql() -> dict[str, str]:
    return {
        "op1_jaccard": OP1_SQL,
        "op4_decontaminate": OP4_SQL,
        "op5_substring": OP5_SQL,
        "op6_mix": OP6_SQL,
        "op8_lines": OP8_SQL,
        "op11_negatives": OP11_SQL,
        "op13_trie": OP13_SQL,
    }
