"""Article-corpus analytics as Spark DataFrame operators."""

from presswork.session import build_session

__all__ = ["build_session"]
