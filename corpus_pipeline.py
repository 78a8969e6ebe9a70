"""The corpus pipeline at the top of the repository; its stages are in barlab.llm.pipeline."""

from barlab.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
