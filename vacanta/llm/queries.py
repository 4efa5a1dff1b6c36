"""The registered queries of this subpackage and the SQL that some of them equal."""

from . import bpe, fingerprints, html_extract, line_dedup, near_dedup, packing, quality_classifier, quality_rules, sharding, toxicity

QUERIES = {
    "op1_quality": quality_classifier.op1_quality,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_bpe": bpe.op4_bpe,
    "op5_html_extract": html_extract.op5_html_extract,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_packing": packing.op7_packing,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_sharding": sharding.op10_sharding,
}
#: The others are trained, iterative or need a tokenizer; tests compare them with plain versions.
SQL = {"op3_line_dedup": line_dedup.OP3_SQL}
