"""The registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, lexical_search, sharding, warc_index
from .cross_polytope import op8_nearest_neighbours
from .decontaminate import op7_decontamination
from .langid_bigru import op3_language_id
from .license_scan import op9_license_scan
from .pii_pseudonyms import op4_pii_pseudonyms
from .sentencepiece_codec import op5_sentencepiece
from .simhash_dedup import op10_simhash_dedup
from .token_binary import op13_token_binary
from .toxicity_segments import op2_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_index": warc_index.op1_warc_index,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_pii_pseudonyms": op4_pii_pseudonyms,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_sharding": sharding.op6_sharding,
    "op7_decontamination": op7_decontamination,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_license_scan": op9_license_scan,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_token_binary": op13_token_binary,
}

#: No SQL where it cannot express the operator; tests/llm holds those against brute force.
SQL: dict[str, str] = {
    "op1_warc_index": warc_index.SQL,
    "op6_sharding": sharding.sql(),
    "op11_lexical_search": lexical_search.SQL,
    "op12_conversation_repair": conversation_repair.SQL,
}
