"""Operators: profiles, checks, rules, physical design, store, request log."""
