"""shopguard: operations analytics for an order shop, expressed as Spark DataFrame jobs.

Order-payload contract checks, fault injection and repair as versioned tables,
PII-safe projections, batch policy decisions over request tables, audit
forensics, and counter-rate alerting in batch and Structured Streaming.
"""

from shopguard.session import checkpoint_dir, get_session

# Fixed values shared with the reference's demo scenario.
ANCHOR = "2026-08-28 09:00:00"
RECONCILE_BATCH = "RECONCILE-BATCH-2026-08-28"

__all__ = ["ANCHOR", "RECONCILE_BATCH", "checkpoint_dir", "get_session"]
