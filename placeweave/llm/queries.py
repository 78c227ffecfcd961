"""The queries of this subpackage over the driver tables, and their SQL where SQL can say them."""

from placeweave.llm import (
    bpe, conversations, credentials, decontaminate, extraction, hard_negatives, multi_index, neardup, oracles, pii,
    quality, records, site_quality, toxicity,
)

QUERIES = {
    "op1_quality_rules": quality.run,
    "op2_secret_scans": credentials.run,
    "op3_html_extraction": extraction.run,
    "op4_quality_classifier": site_quality.run,
    "op5_decontamination": decontaminate.run,
    "op6_near_duplicates": neardup.run,
    "op7_toxicity": toxicity.run,
    "op8_pii": pii.run,
    "op9_bpe": bpe.run,
    "op10_records": records.run,
    "op11_hard_negatives": hard_negatives.run,
    "op12_conversation_repair": conversations.run,
    "op13_multi_index": multi_index.run,
}
ORACLES = {
    "op1_quality_rules": oracles.QUALITY,
    "op2_secret_scans": oracles.SECRETS,
    "op5_decontamination": oracles.LEAKS,
    "op11_hard_negatives": oracles.NEGATIVES,
    "op12_conversation_repair": oracles.REPAIRS,
}
