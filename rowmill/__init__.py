"""Bulk table updates on Spark: validate, deduplicate, chunk, merge and report."""

from rowmill.session import build_session, scratch_dir, shared_base
from rowmill.spec import ACTIONS, ACTION_STATS, CONTACTS, BusinessRule, EntitySpec, FieldRule

__all__ = [
    "ACTIONS",
    "ACTION_STATS",
    "CONTACTS",
    "BusinessRule",
    "EntitySpec",
    "FieldRule",
    "build_session",
    "scratch_dir",
    "shared_base",
]
