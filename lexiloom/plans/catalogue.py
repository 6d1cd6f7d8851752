"""All registered queries of the library with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from . import views

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
_VIEWS = {"segments": views.SEGMENTS, "doc_segments": views.DOC_SEGMENTS, "frames": views.FRAMES, "arcs": views.ARCS, "vectors": views.VECTORS, "order_lines": views.ORDER_LINES}


def query(sql: str | None = None, *uses: str) -> Callable:
    """Register a query under its function's name; ``uses`` names derived tables that the SQL needs."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            heads = [_VIEWS[u] for u in uses]
            body = sql.strip()
            if heads:
                kind = "WITH RECURSIVE " if body[:15].upper() == "WITH RECURSIVE " else "WITH "
                body = f"{kind}{', '.join(heads)}" + (f", {body[len(kind):]}" if body[: len(kind)].upper() == kind else f" {body}")
            ORACLE[f.__name__] = body
        return f

    return register


from . import queries_adaptation, queries_alignment, queries_arcs, queries_confusion, queries_counts, queries_corpus, queries_frames, queries_lattice, queries_models, queries_orthography, queries_slots, queries_transcripts, queries_vectors  # noqa: E402, F401  they register themselves
