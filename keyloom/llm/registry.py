"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from keyloom.llm import base_queries
from keyloom.llm.embedding_dedup import OP2_SQL, op2_sign_hashing
from keyloom.llm.language_id import op5_bidirectional_gru
from keyloom.llm.packing import op10_best_fit
from keyloom.llm.piece_sampling import op3_gumbel_top_k
from keyloom.llm.pii import op8_bootstrapped_contexts
from keyloom.llm.quality import op1_ngram_logistic
from keyloom.llm.sharding import op9_two_pass_shuffle
from keyloom.llm.simhash import op7_simhash
from keyloom.llm.token_shards import op4_feistel_order
from keyloom.llm.url_filter import op6_ngram_logistic

QUERIES = {
    "op1_ngram_logistic": op1_ngram_logistic,
    "op2_sign_hashing": op2_sign_hashing,
    "op3_gumbel_top_k": op3_gumbel_top_k,
    "op4_feistel_order": op4_feistel_order,
    "op5_bidirectional_gru": op5_bidirectional_gru,
    "op6_ngram_logistic": op6_ngram_logistic,
    "op7_simhash": op7_simhash,
    "op8_bootstrapped_contexts": op8_bootstrapped_contexts,
    "op9_two_pass_shuffle": op9_two_pass_shuffle,
    "op10_best_fit": op10_best_fit,
    **base_queries.QUERIES,
}

#: The others follow learned models, hashes or permutations that SQL cannot restate;
#: the fixed columns of three are restated apart, and tests/llm holds each against brute force or an exact round trip.
ORACLE_SQL: dict[str, str] = {"op2_sign_hashing": OP2_SQL, **base_queries.ORACLE_SQL}
