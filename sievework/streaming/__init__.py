"""Streaming: the engine's feature selection is a batch fit, so there are no streaming operators of its own.

A fitted model's transform is a projection and works on streaming DataFrames as it is.
"""
