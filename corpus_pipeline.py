"""A training-data pipeline over ``documents``: each stage keeps or drops rows, the last one encodes."""

from quern.llm.pipeline import STAGES, run

ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
