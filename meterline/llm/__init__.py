"""Training-data operators: quality rules, language ID, mixing, toxicity, packing, dedup, URL and chat operators.

Nothing outside this package imports it.  Every operator takes and returns DataFrames; the thin
registered queries live in :mod:`meterline.llm.queries`.
"""
