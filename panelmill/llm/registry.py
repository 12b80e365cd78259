"""What the entry module adds when this package is there."""

from __future__ import annotations

import corpus_pipeline
from panelmill.llm.oracles import ORACLES
from panelmill.llm.queries import QUERIES


def queries() -> dict:
    return {**QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    more = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**ORACLES, **more}
