"""Registered queries: operator plus the equivalent SQL."""
