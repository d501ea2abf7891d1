"""Queries over the derived genomic relations, and the SQL that holds them to account."""

from __future__ import annotations

from varilume.plans import annotation, haplotype_queries, model_queries, preparation, wider

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (preparation, annotation, model_queries, haplotype_queries, wider):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
