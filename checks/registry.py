"""All registered queries: name -> (query, SQL or None)."""

from checks import edge_checks, log_checks, stream_checks, table_checks, text_checks

CHECKS = {**text_checks.CHECKS, **log_checks.CHECKS, **table_checks.CHECKS, **stream_checks.CHECKS, **edge_checks.CHECKS}
