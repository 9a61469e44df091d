"""A training corpus from ``documents``: the stages of sagebrook.llm.pipeline, one after the other."""

from __future__ import annotations

from sagebrook.llm.pipeline import ORACLE_SQL, STAGES, good_quality, mixed, private_data_masked, run, uncontaminated, unique

__all__ = ["ORACLE_SQL", "STAGES", "good_quality", "mixed", "private_data_masked", "run", "uncontaminated", "unique"]
