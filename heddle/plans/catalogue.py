"""Queries over the driver's tables, one for each operator, with the SQL that states the same."""

from __future__ import annotations

from heddle.plans import campaign_queries, evidence_queries, file_queries, finding_queries, governance_queries, graph_queries, identity_queries, inventory_queries, ledger_queries, observed_queries, policy_queries, summary_queries

_MODULES = (graph_queries, identity_queries, finding_queries, ledger_queries, governance_queries, summary_queries, inventory_queries, observed_queries, evidence_queries, policy_queries, campaign_queries, file_queries)

QUERIES: dict = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
