"""The training-data pipeline over ``documents``; its stages stand with the operators."""

from memweave.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
