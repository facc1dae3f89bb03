"""The queries of this subpackage and their DuckDB SQL."""

from bidloom.llm import conversations, katz, lang_id, mixing, near_dups, pii, quality_rules, resampling, sentencepiece, sharding, spotsigs, substrings, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_sentencepiece": sentencepiece.op2_sentencepiece,
    "op3_mixing": mixing.op3_mixing,
    "op4_pii": pii.op4_pii,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_near_dups": near_dups.op6_near_dups,
    "op7_spotsigs": spotsigs.op7_spotsigs,
    "op8_substrings": substrings.op8_substrings,
    "op9_lang_id": lang_id.op9_lang_id,
    "op10_katz": katz.op10_katz,
    "op11_conversations": conversations.op11_conversations,
    "op12_sharding": sharding.op12_sharding,
    "op13_resampling": resampling.op13_resampling,
}
ORACLE = {
    "op1_warc": warc.ORACLE,
    "op3_mixing": mixing.oracle(),
    "op5_quality_rules": quality_rules.ORACLE,
    "op7_spotsigs": spotsigs.ORACLE,
    "op11_conversations": conversations.ORACLE,
    "op12_sharding": sharding.ORACLE,
    "op13_resampling": resampling.ORACLE,
}
