"""The queries of this subpackage, as __spark_entry__ registers them, and their SQL where SQL can express them.

None has SQL: DuckDB has neither the hashes, the tokenizer, the random draws and the bounded-error matching of these
operators nor their fixed points over links. tests/llm holds each against a brute-force version instead.
"""

from __future__ import annotations

from . import embed_dedup, html_main, langid, license_scan, mixing, multiset_hash, packing, pii, simhash, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_multiset_fingerprints": multiset_hash.query,
    "op3_packing": packing.query,
    "op4_embedding_near_dedup": embed_dedup.query,
    "op5_pii_pseudonyms": pii.query,
    "op6_html_main_text": html_main.query,
    "op7_source_mixing": mixing.query,
    "op8_license_scan": license_scan.query,
    "op9_simhash_near_dedup": simhash.query,
    "op10_language_id": langid.query,
}
ORACLE_SQL: dict[str, str] = {}
