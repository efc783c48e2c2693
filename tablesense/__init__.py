"""tablesense: a Spark-native dataset profiler and storage adviser.

Every operator is a lazily evaluated DataFrame transformation. The core
frames are ``column_profile`` (one row per table x column) and
``table_profile`` (one row per table); rules, checks and physical design
are joins, filters and aggregations over them.
"""

from tablesense.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
