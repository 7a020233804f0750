"""Tessera: a PySpark-native engine for wide-table analytics.

Every operator is a pure ``DataFrame -> DataFrame`` function that only adds to
the logical plan, so Catalyst sees whole queries and prunes, pushes down and
fuses across operator borders.
"""

from tessera.session import get_session

__all__ = ["get_session"]
