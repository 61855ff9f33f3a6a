"""The registered queries of this subpackage and the SQL some of them are checked against."""

from __future__ import annotations

from keepsake.llm import codes, decontamination, fingerprints, line_dedup, mixing, near_dedup, neighbours, phrases, quality, substrings, tokens, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_line_dedup": line_dedup.query,
    "op3_warc": warc.query,
    "op4_quality": quality.query,
    "op5_decontamination": decontamination.query,
    "op6_substrings": substrings.query,
    "op7_neighbours": neighbours.query,
    "op8_near_dedup": near_dedup.query,
    "op9_token_files": tokens.query,
    "op10_mixing": mixing.query,
    "op11_phrases": phrases.query,
    "op12_fingerprints": fingerprints.query,
    "op13_codes": codes.query,
}
ORACLES = {
    "op3_warc": warc.SQL,
    "op5_decontamination": decontamination.SQL,
    "op10_mixing": mixing.SQL,
    "op11_phrases": phrases.SQL,
    "op13_codes": codes.SQL,
}
