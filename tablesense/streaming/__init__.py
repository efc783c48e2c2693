"""Structured Streaming jobs: incremental daily roll-up (T1) and
new-file profiling into the profile store (T2)."""
