"""Session-log analytics on Spark: who spent which tokens, when, and at what price."""

from sessionledger.session import scratch_dir, spark_session

__all__ = ["scratch_dir", "spark_session"]
