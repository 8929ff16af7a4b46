"""Registered queries and their SQL oracles.

Importing this package registers every query module.
"""

from vetrina.plans import (q_access, q_export, q_files, q_lineage, q_malformed, q_mapping, q_normalize,  # noqa: F401
                           q_profile, q_quality, q_reports, q_resolve, q_similar, q_streaming, q_upsert, q_validation)
from vetrina.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
