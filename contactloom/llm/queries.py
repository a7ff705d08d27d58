"""Registered queries of the operators, and their SQL twins."""

from __future__ import annotations

from contactloom.llm import disclosure, edits, exact, manifest, runs, language, licenses, lines, minhash, mixing, pieces, toxicity, vectors

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_edit_fingerprints": edits.op2_edit_fingerprints,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_personal_data": disclosure.op5_personal_data,
    "op6_vector_forest": vectors.op6_vector_forest,
    "op7_language_id": language.op7_language_id,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_sample_pieces": pieces.op9_sample_pieces,
    "op10_minhash": minhash.op10_minhash,
    "op11_exact_dedup": exact.op11_exact_dedup,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

ORACLES = {
    "op1_line_dedup": lines.ORACLE,
    "op4_mix_sources": mixing.ORACLE,
    "op8_license_scan": licenses.ORACLE,
    "op11_exact_dedup": exact.ORACLE,
}
