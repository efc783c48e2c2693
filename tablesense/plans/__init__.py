"""Named queries over the test catalog and their DuckDB oracle SQL."""


def load_queries():
    """Import every query module and return (QUERIES, ORACLE)."""
    from tablesense.plans import q_profile  # noqa: F401
    from tablesense.plans.registry import ORACLE, QUERIES
    for mod in ("q_rules", "q_design", "q_ingest", "q_store", "q_log", "q_stream"):
        try:
            __import__(f"tablesense.plans.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"tablesense.plans.{mod}":
                raise
    return QUERIES, ORACLE
