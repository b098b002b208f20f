"""A small SELECT dialect over layers, compiled to DataFrame columns."""

from .compiler import execute_sql, where

__all__ = ["execute_sql", "where"]
