"""Operators of a training-data pipeline; the rest of the library doesn't use them."""
