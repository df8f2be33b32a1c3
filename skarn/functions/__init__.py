"""Scalar expressions and pure Python helpers."""
