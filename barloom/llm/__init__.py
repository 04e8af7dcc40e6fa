"""Operators for training-data pipelines: media, language, tokens, quality, dedup and the like.

Nothing outside this package imports it; ``queries`` holds what the entry module registers.
"""
