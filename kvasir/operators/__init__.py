"""Analytic operators, one module per area."""
