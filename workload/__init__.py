"""Registered queries: each theme module holds QUERIES and the matching ORACLES."""
