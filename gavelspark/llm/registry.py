"""The queries of this subpackage, and the SQL of those that SQL can express."""

from . import byte_bpe, chat, clusters, fingerprints, html_text, language_id, mixing, phrases, quality, quality_rules, secrets, simhash, topk

QUERIES = {"op1_html_text": html_text.op1, "op2_mixing": mixing.op2, "op3_byte_bpe": byte_bpe.op3, "op4_quality": quality.op4, "op5_secrets": secrets.op5, "op6_simhash": simhash.op6, "op7_chat": chat.op7, "op8_fingerprints": fingerprints.op8, "op9_topk": topk.op9, "op10_language_id": language_id.op10, "op11_quality_rules": quality_rules.op11, "op12_clusters": clusters.op12, "op13_phrases": phrases.op13}
ORACLE_SQL: dict[str, str] = {"op9_topk": topk.SQL, "op11_quality_rules": quality_rules.SQL, "op12_clusters": clusters.SQL, "op13_phrases": phrases.SQL}
