"""Operators for preparing training text: scoring, matching, extraction, packing and placement."""
