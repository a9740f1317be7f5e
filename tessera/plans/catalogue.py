"""All queries of the media engine with their SQL."""

from __future__ import annotations

from tessera.plans import aggregate_queries, effect_queries, enhance_queries, fold_queries, grading_queries, media_queries, nebula_queries, pixel_queries, procedural_queries, render_queries, scalar_queries, source_queries, speaker_queries, stencil_queries, stream_queries, temporal_queries, timeline_queries

MODULES = [temporal_queries, aggregate_queries, pixel_queries, scalar_queries, fold_queries, effect_queries, grading_queries, procedural_queries, stencil_queries, speaker_queries, media_queries, source_queries, timeline_queries, stream_queries, render_queries, enhance_queries, nebula_queries]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items() if sql}
