"""The queries of the text operators and their SQL."""

from __future__ import annotations

from . import bpe, importance, jaccard, licenses, lpf_dedup, packing, phrases, pii, quality_knn, quality_rules, toxicity, warc, winnow

QUERIES = {
    "op6_licenses": licenses.op6_licenses,
    "op7_lpf_dedup": lpf_dedup.op7_lpf_dedup,
    "op10_jaccard": jaccard.op10_jaccard,
    "op1_quality_knn": quality_knn.op1_quality_knn,
    "op8_toxicity": toxicity.op8_toxicity,
    "op3_warc": warc.op3_warc,
    "op2_bpe": bpe.op2_bpe,
    "op4_pii": pii.op4_pii,
    "op5_winnowing": winnow.op5_winnowing,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op11_packing": packing.op11_packing,
    "op12_collocations": phrases.op12_collocations,
    "op13_importance": importance.op13_importance,
}

SQL = {
    "op13_importance": importance.SQL,
    "op12_collocations": phrases.SQL,
    "op4_pii": pii.SQL,
    "op6_licenses": licenses.SQL,
    "op10_jaccard": jaccard.SQL,
    "op3_warc": warc.SQL,
    "op5_winnowing": winnow.SQL,
    "op9_quality_rules": quality_rules.SQL,
}
