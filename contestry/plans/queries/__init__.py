"""Registered queries by family."""

from contestry.plans.catalogue import QUERIES, oracle, run
from contestry.plans.queries import editions, filters, ledger, model, relational, storage, studies, tables  # noqa: F401

__all__ = ["QUERIES", "oracle", "run"]
