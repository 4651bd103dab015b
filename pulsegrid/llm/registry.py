"""The training-data queries and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pulsegrid.llm.decontam import OP6_SQL, op6_decontamination
from pulsegrid.llm.fim import OP11_SQL, op11_fill_in_middle
from pulsegrid.llm.licenses import op7_license_scan
from pulsegrid.llm.line_dedup import op9_line_dedup
from pulsegrid.llm.minhash import op10_minhash
from pulsegrid.llm.mixing import OP8_SQL, op8_mixing
from pulsegrid.llm.pieces import op13_pieces
from pulsegrid.llm.pii import op1_pii
from pulsegrid.llm.quality import op3_quality_rules
from pulsegrid.llm.search import OP12_SQL, op12_search
from pulsegrid.llm.sharding import op4_sharding
from pulsegrid.llm.tokens import op5_token_counts
from pulsegrid.llm.url_filter import OP2_SQL, op2_url_filter

QUERIES = {
    "op1_pii": op1_pii,
    "op2_url_filter": op2_url_filter,
    "op3_quality_rules": op3_quality_rules,
    "op4_sharding": op4_sharding,
    "op5_token_counts": op5_token_counts,
    "op6_decontamination": op6_decontamination,
    "op7_license_scan": op7_license_scan,
    "op8_mixing": op8_mixing,
    "op9_line_dedup": op9_line_dedup,
    "op10_minhash": op10_minhash,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_search": op12_search,
    "op13_pieces": op13_pieces,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op2_url_filter": OP2_SQL, "op6_decontamination": OP6_SQL, "op8_mixing": OP8_SQL, "op11_fill_in_middle": OP11_SQL, "op12_search": OP12_SQL}
