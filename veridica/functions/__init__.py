"""Part of the evidence-graph engine."""
