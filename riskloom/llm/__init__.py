"""Operators for preparing training text: counting, deduplicating, scoring, encoding and formatting documents."""
