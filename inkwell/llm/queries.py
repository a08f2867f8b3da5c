"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from .bpe import op10_byte_bpe
from .chat_format import OP8_SQL, op8_chat_formatting
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .fingerprints import op4_document_fingerprints
from .jaccard_join import op3_ngram_jaccard
from .langid import op6_language_id
from .licenses import op5_license_scans
from .line_dedup import OP1_SQL, op1_line_dedup
from .packing import op7_best_fit_packing
from .token_counts import op2_token_counts


def queries() -> dict:
    return {"op1_line_dedup": op1_line_dedup, "op2_token_counts": op2_token_counts, "op3_ngram_jaccard": op3_ngram_jaccard, "op4_document_fingerprints": op4_document_fingerprints, "op5_license_scans": op5_license_scans, "op6_language_id": op6_language_id, "op7_best_fit_packing": op7_best_fit_packing, "op8_chat_formatting": op8_chat_formatting, "op9_exact_dedup": op9_exact_dedup, "op10_byte_bpe": op10_byte_bpe}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op8_chat_formatting": OP8_SQL, "op9_exact_dedup": OP9_SQL}
