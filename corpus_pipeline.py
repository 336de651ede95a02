"""A training corpus from raw documents: reject low quality, keep one of each near-duplicate group, redact personal data,
mix the sources to their target weights, and encode. Every stage is written as Parquet and read again by the next.
"""

from cladeframe.llm.stages import STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: SQL cannot express the trained classifier; tests/llm hold the stages against brute force.
ORACLE_SQL = None
