"""Every registered query of the engine's own operators, with the SQL that states it."""

from __future__ import annotations

from veriframe.plans import alignment_plans, assessment_plans, capture_plans, claim_plans, comparison_plans, evidence_plans, form_plans, history_plans, outline_plans, percentage_plans, proof_plans, readiness_plans, recovery_plans, scope_plans, segment_plans, source_plans, summary_plans, text_plans

_MODULES = (text_plans, assessment_plans, alignment_plans, claim_plans, segment_plans, outline_plans, form_plans, percentage_plans, recovery_plans, proof_plans, scope_plans, history_plans, summary_plans, comparison_plans, evidence_plans, source_plans, readiness_plans, capture_plans)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: statement for m in _MODULES for name, statement in m.ORACLE_SQL.items()}
