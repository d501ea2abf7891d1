"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from varilume.llm import decontam, licenses, mixing, pii, secrets, simhash, sketch, substrings, toxicity, urlfilter

QUERIES = {
    f.__name__: f
    for f in (simhash.op1_simhash, mixing.op2_mixing, secrets.op3_secrets, decontam.op4_decontamination, pii.op5_pii, urlfilter.op6_urlfilter, sketch.op7_fingerprints, licenses.op8_licenses, substrings.op9_substrings, toxicity.op10_toxicity)
}
ORACLES = {"op6_urlfilter": urlfilter.OP6_SQL}
