"""The numbered queries of this folder, by name, and the SQL that states some of them."""

from __future__ import annotations

from .ann import op6_nearest_neighbours
from .knn import OP9_SQL, op9_exact_top_k
from .langid import op7_language_id
from .lexical import OP12_SQL, op12_ranked_lexical_search
from .licenses import op4_license_scans
from .packing import op3_best_fit_packing
from .pieces import op10_piece_encoding
from .quality import op5_quality_classifier
from .quotes import OP2_SQL, op2_chat_formatting
from .sharding import op13_sharding
from .simhash import op8_simhash_near_dedup
from .substrings import OP1_SQL, op1_substring_dedup
from .trie import OP11_SQL, op11_conversation_trie

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_license_scans": op4_license_scans,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_language_id": op7_language_id,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_piece_encoding": op10_piece_encoding,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_ranked_lexical_search": op12_ranked_lexical_search,
    "op13_sharding": op13_sharding,
}

ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op2_chat_formatting": OP2_SQL, "op9_exact_top_k": OP9_SQL, "op11_conversation_trie": OP11_SQL, "op12_ranked_lexical_search": OP12_SQL}
