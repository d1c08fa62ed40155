"""The corpus pipeline's stages; their code is in poolstat.llm.pipeline."""

from poolstat.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
