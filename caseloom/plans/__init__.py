"""The registered queries."""

from __future__ import annotations


def load() -> tuple[dict, dict]:
    """(queries, SQL) of all modules here."""
    from caseloom.plans import cases, logs, manifests, registry, scalars, texts  # noqa: F401

    return dict(registry.QUERIES), dict(registry.ORACLES)
