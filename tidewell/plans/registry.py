"""Name to query and name to DuckDB SQL, for everything outside tidewell.llm."""

from __future__ import annotations

from tidewell.plans import chats, data, details, indexes, pairs, profile, retrieval, runs, stores, texts  # noqa: F401  they register their plans
from tidewell.plans.base import ORACLE, QUERIES  # noqa: F401
