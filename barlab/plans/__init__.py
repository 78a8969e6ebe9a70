"""The named queries and the SQL that says the same; importing this package fills the tables of registry."""

from barlab.plans import registry, strategies, research, selection, relations, frame, signals, ledger, gates, portfolio, context, patterns  # noqa: F401,I001  (each adds to those before it)
from barlab.streaming import state as _state

registry.QUERIES |= {"st1_forward_scores": _state.forward_scores, "st3_risk_gate": _state.risk_gate_query, "st4_decayed_profiles": _state.decayed_profiles}
registry.SQL |= {"st1_forward_scores": _state.FORWARD_SQL, "st3_risk_gate": _state.GATE_SQL, "st4_decayed_profiles": _state.PROFILE_SQL}
