"""Named queries over the driver tables."""

from .base import REGISTRY, Query


def load_all() -> dict[str, Query]:
    """Import every query module and return the registry."""
    from . import alignments, audit_queries, digests, evaluation, fits, overrides, posts, reading, searches, vectors  # noqa: F401

    return REGISTRY
