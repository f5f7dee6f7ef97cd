"""Spark-native session analytics over user activity logs."""

from sessionlens.session import build_session, prepare

__all__ = ["build_session", "prepare"]
