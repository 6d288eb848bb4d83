"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from factflow.llm import exact_dedup, licenses, lm, media, mixing, packing, simhash, token_files, toxicity, warc

QUERIES = {
    "op1_pareto_mixing": mixing.op1_pareto_mixing,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_lm_scoring": lm.op3_lm_scoring,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_token_files": token_files.op5_token_files,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_warc_derivatives": warc.op7_warc_derivatives,
    "op8_simhash": simhash.op8_simhash,
    "op9_media_copies": media.op9_media_copies,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}

SQL = {
    "op2_license_scan": licenses.OP2_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op7_warc_derivatives": warc.OP7_SQL,
}
