"""The corpus pipeline: five stages over documents. Their code is in facetry.llm.pipeline."""

from facetry.llm.pipeline import STAGES, run

#: No stage but decontamination is expressible in SQL; tests hold the whole against brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
