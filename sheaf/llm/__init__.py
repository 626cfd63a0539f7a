"""Operators for training-data pipelines.

One module per operator (``fingerprints``, ``licenses``, ``tokens``, ``secrets``,
``packing``, ``langid``, ``neardup``, ``archive``, ``decontam``, ``quality``), plus
``queries`` which registers them.  Nothing outside this package imports it.
"""
