"""The queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

from cartoweave.llm import decontaminate, html_text, kneser_ney, language_id, line_dedup, packing, pii, quality_rules, resampling, simhash, suffix_dedup, vector_codes, warc

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_quality_model": kneser_ney.op2_quality_model,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_packing": packing.op4_packing,
    "op5_simhash": simhash.op5_simhash,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_warc": warc.op9_warc,
    "op10_pii": pii.op10_pii,
    "op11_html_text": html_text.op11_html_text,
    "op12_resampling": resampling.op12_resampling,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

SQL = {
    "op1_language_id": language_id.SQL,
    "op2_quality_model": kneser_ney.SQL,
    "op3_decontamination": decontaminate.SQL,
    "op4_packing": packing.SQL,
    "op6_suffix_dedup": suffix_dedup.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op8_quality_rules": quality_rules.SQL,
    "op9_warc": warc.SQL,
    "op12_resampling": resampling.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
