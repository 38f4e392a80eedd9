"""Operators for preparing text that language models are trained on. Nothing outside this package imports it."""
