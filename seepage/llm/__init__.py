"""Operators that prepare a text corpus for training: packing, duplicates, counting, token files, filters, shards.

Nothing outside this package imports it; its queries are in ``seepage.llm.queries``.
"""
