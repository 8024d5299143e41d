"""Registered queries of the operators, and the SQL of those that SQL can express."""

from ripple.llm.chat import OP11_SQL, op11_chat_formatting
from ripple.llm.clustering import OP13_SQL, op13_walsh_clusters
from ripple.llm.cotrain import op10_cotraining
from ripple.llm.decontam import OP6_SQL, op6_containment
from ripple.llm.hamming import op5_minhash_hamming
from ripple.llm.importance import op12_importance
from ripple.llm.lattice import op3_lattice
from ripple.llm.licenses import op2_license_scan
from ripple.llm.lines import op9_line_dedup
from ripple.llm.mixing import OP1_SQL, op1_mixing
from ripple.llm.sharding import OP4_SQL, op4_extendible_sharding
from ripple.llm.token_counts import op8_token_counts
from ripple.llm.token_store import op7_token_store

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_license_scan": op2_license_scan,
    "op3_lattice": op3_lattice,
    "op4_extendible_sharding": op4_extendible_sharding,
    "op5_minhash_hamming": op5_minhash_hamming,
    "op6_containment": op6_containment,
    "op7_token_store": op7_token_store,
    "op8_token_counts": op8_token_counts,
    "op9_line_dedup": op9_line_dedup,
    "op10_cotraining": op10_cotraining,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_importance": op12_importance,
    "op13_walsh_clusters": op13_walsh_clusters,
}
SQL = {
    "op1_mixing": OP1_SQL,
    "op4_extendible_sharding": OP4_SQL,
    "op6_containment": OP6_SQL,
    "op11_chat_formatting": OP11_SQL,
    "op13_walsh_clusters": OP13_SQL,
}
