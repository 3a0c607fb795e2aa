"""The corpus pipeline: toxicity, line deduplication, near duplicates, benchmark decontamination, SentencePiece encoding.

What the stages do, and what they do with nulls, repeated ids and empty texts, is said in tessera/llm/pipeline.py.
"""

from __future__ import annotations

from tessera.llm.pipeline import ORACLE_SQL, STAGES, drop_contaminated, drop_near_duplicates, drop_repeated_lines, drop_toxic, run, tokenize

__all__ = ["ORACLE_SQL", "STAGES", "drop_contaminated", "drop_near_duplicates", "drop_repeated_lines", "drop_toxic", "run", "tokenize"]
