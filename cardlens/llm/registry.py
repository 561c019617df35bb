"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op9_bpe
from .fingerprint import op4_fingerprints
from .langid import op7_language_id
from .line_dedup import OP6_SQL, op6_line_dedup
from .mixing import OP2_SQL, op2_source_mix
from .secret_scan import OP5_SQL, op5_secret_scan
from .simhash_dedup import op3_simhash_dedup
from .topk import OP10_SQL, op10_topk
from .toxicity import op1_toxicity
from .warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_source_mix": op2_source_mix,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_fingerprints": op4_fingerprints,
    "op5_secret_scan": op5_secret_scan,
    "op6_line_dedup": op6_line_dedup,
    "op7_language_id": op7_language_id,
    "op8_warc": op8_warc,
    "op9_bpe": op9_bpe,
    "op10_topk": op10_topk,
}
ORACLE_SQL = {
    "op2_source_mix": OP2_SQL,
    "op5_secret_scan": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op8_warc": OP8_SQL,
    "op10_topk": OP10_SQL,
}
