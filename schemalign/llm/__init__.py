"""Operators for preparing training data; nothing outside this package and the pipeline imports them."""
