"""Bank-transaction analytics as Spark DataFrame plans."""

from ledgerspark.session import build_session

__all__ = ["build_session"]
