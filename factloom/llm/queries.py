"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from .byte_bpe import op2_byte_bpe
from .decontamination import op7_decontamination
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .language_id import op8_language_id
from .license_scan import op10_license_scan
from .near_dedup import OP4_SQL, op4_near_dedup
from .secret_scan import op9_secret_scan
from .sharding import op1_sharding
from .token_files import op6_token_files
from .toxicity import op5_toxicity

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_token_files": op6_token_files,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op9_secret_scan": op9_secret_scan,
    "op10_license_scan": op10_license_scan,
}

ORACLE_SQL = {
    "op3_exact_dedup": OP3_SQL,
    "op4_near_dedup": OP4_SQL,
}
