"""Registered queries over the driver tables and their DuckDB SQL."""

from __future__ import annotations

from pulseloom.plans import framing_queries, learning_queries, profile_queries, stats_queries, stream_queries, waveform_queries  # noqa: F401
from pulseloom.plans.registry import QUERIES, SQL  # noqa: F401
