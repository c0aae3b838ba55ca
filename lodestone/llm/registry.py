"""One query per operator, with SQL where SQL can express it."""

from __future__ import annotations

from lodestone.llm import alignment, chat, decontaminate, exact_dedup, html_text, infill, katz, mixing, quality, simhash, substring, token_files, toxicity

QUERIES = {
    "op1_substring_dedup": substring.query,
    "op2_katz_scoring": katz.query,
    "op3_mixing": mixing.query,
    "op4_toxicity": toxicity.query,
    "op5_quality": quality.query,
    "op6_html_text": html_text.query,
    "op7_token_files": token_files.query,
    "op8_decontamination": decontaminate.query,
    "op9_simhash_dedup": simhash.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_infill": infill.query,
    "op12_token_alignment": alignment.query,
    "op13_chat_format": chat.query,
}
SQL = {"op3_mixing": mixing.SQL, "op10_exact_dedup": exact_dedup.SQL}
