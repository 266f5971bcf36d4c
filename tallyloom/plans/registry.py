"""All queries of the engine by name, with their SQL twins."""

from __future__ import annotations

from tallyloom.plans import q_bank, q_dedup, q_labels, q_pages, q_text  # noqa: F401
from tallyloom.plans.base import ORACLE, QUERIES  # noqa: F401
