"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from lanternfish.llm.conversations import OP12_SQL, op12_interval_repair
from lanternfish.llm.minhash import op11_bayesian_minhash
from lanternfish.llm.mixing import op10_context_mixing
from lanternfish.llm.packing import op4_length_buckets
from lanternfish.llm.permutation_index import op1_permutation_index
from lanternfish.llm.pieces import op6_sentencepiece
from lanternfish.llm.planes import op5_token_planes
from lanternfish.llm.secrets import op9_secrets
from lanternfish.llm.simhash import op7_simhash
from lanternfish.llm.suffix_dedup import op3_prefix_free
from lanternfish.llm.threshold import OP2_SQL, op2_uniform_threshold
from lanternfish.llm.toxicity import op8_toxicity
from lanternfish.llm.vector_codes import OP13_SQL, op13_anchor_codes

QUERIES = {
    "op10_context_mixing": op10_context_mixing,
    "op11_bayesian_minhash": op11_bayesian_minhash,
    "op12_interval_repair": op12_interval_repair,
    "op13_anchor_codes": op13_anchor_codes,
    "op1_permutation_index": op1_permutation_index,
    "op2_uniform_threshold": op2_uniform_threshold,
    "op3_prefix_free": op3_prefix_free,
    "op4_length_buckets": op4_length_buckets,
    "op5_token_planes": op5_token_planes,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_secrets": op9_secrets,
}

ORACLES: dict[str, str] = {
    "op12_interval_repair": OP12_SQL,
    "op13_anchor_codes": OP13_SQL,
    "op2_uniform_threshold": OP2_SQL,
}
