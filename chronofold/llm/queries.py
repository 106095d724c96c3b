"""The queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat import OP1_SQL, op1_chat_formatting
from .collocations import OP13_SQL, op13_phrase_collocations
from .decontaminate import OP7_SQL, op7_decontamination
from .embeddings import OP3_SQL, op3_embedding_near_dedup
from .eodscan import op8_token_counts
from .langid import op6_language_id
from .licenses import OP12_SQL, op12_license_scan
from .packing import op10_packing
from .quality import op5_quality_classifier
from .sharding import OP9_SQL, op9_sharding
from .simhash import op2_simhash_near_dedup
from .tokenfile import op4_token_files
from .whitening import op11_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_simhash_near_dedup, op3_embedding_near_dedup, op4_token_files, op5_quality_classifier,
        op6_language_id, op7_decontamination, op8_token_counts, op9_sharding, op10_packing, op11_embedding_whitening,
        op12_license_scan, op13_phrase_collocations,
    )
}
ORACLES = {
    "op1_chat_formatting": OP1_SQL, "op3_embedding_near_dedup": OP3_SQL, "op7_decontamination": OP7_SQL, "op9_sharding": OP9_SQL, "op12_license_scan": OP12_SQL,
    "op13_phrase_collocations": OP13_SQL,
}
