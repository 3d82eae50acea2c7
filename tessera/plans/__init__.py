"""Registered queries: each module registers its own when the package is imported."""

from . import acceptance, catalog, crosswalks, curriculum, graphs, guards, imports, index, lifecycle, payloads, quality, queues, reads, registry, review, search, sheets, streams  # noqa: F401
