"""The queries of this subpackage and their SQL, as the entry point registers them."""

from __future__ import annotations

from tessera.llm.chat_format import OP3_SQL, op3_chat_format
from tessera.llm.clustering import OP11_SQL, op11_clustering
from tessera.llm.language_id import op2_language_id
from tessera.llm.packing import op5_packing
from tessera.llm.periodic import op12_periodic_runs
from tessera.llm.pivot_search import OP4_SQL, op4_pivot_topk
from tessera.llm.repeats import op8_suffix_dedup
from tessera.llm.sentencepiece_codec import op1_sentencepiece
from tessera.llm.sharding import op13_sharding
from tessera.llm.simhash import op7_simhash
from tessera.llm.token_files import op6_token_files
from tessera.llm.sketches import op9_fingerprints
from tessera.llm.warc import op10_warc

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language_id": op2_language_id,
    "op3_chat_format": op3_chat_format,
    "op4_pivot_topk": op4_pivot_topk,
    "op5_packing": op5_packing,
    "op6_token_files": op6_token_files,
    "op7_simhash": op7_simhash,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_fingerprints": op9_fingerprints,
    "op10_warc": op10_warc,
    "op11_clustering": op11_clustering,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_sharding": op13_sharding,
}
#: DuckDB SQL of those queries that SQL can express on whole tables; the others have brute-force tests.
ORACLE_SQL: dict[str, str] = {"op3_chat_format": OP3_SQL, "op4_pivot_topk": OP4_SQL, "op11_clustering": OP11_SQL}
