"""What ``__spark_entry__`` registers of this subpackage."""

from __future__ import annotations

import corpus_pipeline
from quillon.llm import oracles
from quillon.llm.bwt_dedup import op10_suffix_dedup
from quillon.llm.decontaminate import op7_decontamination
from quillon.llm.fingerprints import op5_fingerprints
from quillon.llm.jaccard import op4_jaccard_join as _op4
from quillon.llm.langid import op9_language_id
from quillon.llm.licenses import op1_license_scan
from quillon.llm.packing import op2_packing
from quillon.llm.quality import op3_quality
from quillon.llm.secrets import op8_secret_scan
from quillon.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_jaccard_join": _op4,
    "op5_fingerprints": op5_fingerprints,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_secret_scan": op8_secret_scan,
    "op9_language_id": op9_language_id,
    "op10_suffix_dedup": op10_suffix_dedup,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op1_license_scan": oracles.license_scan(), "op4_jaccard_join": oracles.JACCARD, "op7_decontamination": oracles.CONTAMINATION}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
__all__ = ["ORACLES", "QUERIES"]
