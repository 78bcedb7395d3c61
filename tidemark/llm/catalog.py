"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm.bpe import op3_byte_bpe
from tidemark.llm.centroids import OP13_SQL, op13_ns_bounds
from tidemark.llm.chat import OP12_SQL, op12_prefix_chats
from tidemark.llm.lattice import op2_lattice_links
from tidemark.llm.lines import OP4_SQL, op4_site_line_dedup
from tidemark.llm.mixing import OP1_SQL, op1_source_mix
from tidemark.llm.mtree import OP7_SQL, op7_mtree_top5
from tidemark.llm.near import op6_order_minhash
from tidemark.llm.passages import op5_repeated_passages
from tidemark.llm.quality import op10_quality_qda
from tidemark.llm.resample import OP11_SQL, op11_segment_resample
from tidemark.llm.tokenfile import op8_repair_tokens
from tidemark.llm.warc import OP9_SQL, op9_warc_segments

QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_lattice_links": op2_lattice_links,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_site_line_dedup": op4_site_line_dedup,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_order_minhash": op6_order_minhash,
    "op7_mtree_top5": op7_mtree_top5,
    "op8_repair_tokens": op8_repair_tokens,
    "op9_warc_segments": op9_warc_segments,
    "op10_quality_qda": op10_quality_qda,
    "op11_segment_resample": op11_segment_resample,
    "op12_prefix_chats": op12_prefix_chats,
    "op13_ns_bounds": op13_ns_bounds,
}

ORACLE_SQL = {
    "op1_source_mix": OP1_SQL,
    "op4_site_line_dedup": OP4_SQL,
    "op7_mtree_top5": OP7_SQL,
    "op9_warc_segments": OP9_SQL,
    "op11_segment_resample": OP11_SQL,
    "op12_prefix_chats": OP12_SQL,
    "op13_ns_bounds": OP13_SQL,
}
