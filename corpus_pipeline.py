"""The corpus pipeline: quality rules, language ID, near-duplicates, decontamination, mixing."""

from vigilark.llm.pipeline import ORACLE_SQL, STAGES, decontaminate, language_id, mix, near_dedup, quality_rules, run

__all__ = ["ORACLE_SQL", "STAGES", "decontaminate", "language_id", "mix", "near_dedup", "quality_rules", "run"]
