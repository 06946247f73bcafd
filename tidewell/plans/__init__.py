"""Statements: what a query asks for."""

from tidewell.plans.statement import GROUP_BY_MS, Statement

__all__ = ["GROUP_BY_MS", "Statement"]
