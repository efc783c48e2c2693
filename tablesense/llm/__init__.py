"""Operators for preparing large text collections: URL filters, license
scans, near and exact duplicates, toxicity, language ID, mixing, chat
formatting and byte-level BPE. Nothing else in the library imports this
package; ``queries.load()`` returns its named queries and their oracle SQL."""
