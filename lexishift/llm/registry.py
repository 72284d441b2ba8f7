"""Queries of the subpackage and, where SQL can express them, what DuckDB says."""

from __future__ import annotations

import corpus_pipeline
from lexishift.llm import automaton, brown, chroma, linededup, minhash, packing, phrases, pii, quality, variants, vectors, warc, wavelet


def queries():
    out = {
        "op1_warc": warc.op1_warc,
        "op2_minhash": minhash.op2_minhash,
        "op3_pii": pii.op3_pii,
        "op4_wavelet": wavelet.op4_wavelet,
        "op5_line_dedup": linededup.op5_line_dedup,
        "op6_bpe": automaton.op6_bpe,
        "op7_packing": packing.op7_packing,
        "op8_brown": brown.op8_brown,
        "op9_chroma": chroma.op9_chroma,
        "op10_quality": quality.op10_quality,
        "op11_embeddings": vectors.op11_embeddings,
        "op12_phrases": phrases.op12_phrases,
        "op13_variants": variants.op13_variants,
        "pipeline": corpus_pipeline.run,
    }
    return out


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": linededup.ORACLE_OP5, "op10_quality": quality.oracle_op10(), "op11_embeddings": vectors.ORACLE_OP11, "op12_phrases": phrases.ORACLE_OP12}
