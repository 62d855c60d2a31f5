"""Operators of a training-data pipeline: language ID, packing, archives, near duplicates and the like.

Nothing outside this folder imports it, so it can be removed whole.
"""
