"""The operators of this subpackage as registered queries, and the SQL they are held against."""

from __future__ import annotations

from . import ann, jaccard, lattice, mixing, packing, quality, sharding, tokencount, toxicity, warc
from .oracle import ORACLE_SQL

QUERIES = {
    "op1_quality_rules": quality.op1,
    "op2_sharding": sharding.op2,
    "op3_nearest_neighbours": ann.op3,
    "op4_warc": warc.op4,
    "op5_ngram_jaccard": jaccard.op5,
    "op6_toxicity": toxicity.op6,
    "op7_lattice_likelihood": lattice.op7,
    "op8_mixing": mixing.op8,
    "op9_packing": packing.op9,
    "op10_token_counts": tokencount.op10,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
