"""The corpus pipeline: quality rules, near duplicates, personal data, mixing and packing, in this order. Its stages are in vellum/llm/pipeline.py."""

from vellum.llm.pipeline import ORACLE_SQL, STAGES, mixing, near_duplicates, packing, personal_data, quality_rules, run

__all__ = ["ORACLE_SQL", "STAGES", "mixing", "near_duplicates", "packing", "personal_data", "quality_rules", "run"]
