"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from siftline.llm import chat_format, decontaminate, language_id, mixing, quality_classifier, quality_rules, repeats, secrets, simhash, toxicity

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_repeats": repeats.op2_repeats,
    "op3_language_id": language_id.op3_language_id,
    "op4_secrets": secrets.op4_secrets,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_simhash": simhash.op9_simhash,
    "op10_mixing": mixing.op10_mixing,
}

SQL = {**repeats.SQL, **secrets.SQL, **decontaminate.SQL, **quality_rules.SQL, **mixing.SQL}
