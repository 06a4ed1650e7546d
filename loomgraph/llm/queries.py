"""The queries of this subpackage and their SQL, for the driver contract."""

from __future__ import annotations

from . import bpe, collocation, langid, licenses, linefirst, media, mixing, neardup, quality, sharding, topk, toxicity, trie

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_mixing": mixing.query,
    "op3_licenses": licenses.query,
    "op4_quality": quality.query,
    "op5_language": langid.query,
    "op6_media": media.query,
    "op7_sharding": sharding.query,
    "op8_near_duplicates": neardup.query,
    "op9_line_rules": linefirst.query,
    "op10_bpe": bpe.query,
    "op11_topk": topk.query,
    "op12_prefix_trie": trie.query,
    "op13_collocations": collocation.query,
}
ORACLE_SQL = {
    "op2_mixing": mixing.ORACLE,
    "op8_near_duplicates": neardup.ORACLE,
    "op9_line_rules": linefirst.ORACLE,
    "op11_topk": topk.ORACLE,
    "op12_prefix_trie": trie.ORACLE,
    "op13_collocations": collocation.ORACLE,
}
