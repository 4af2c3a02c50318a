"""Training-data operators: packing, token counts, quality, dedup, language, URLs, decontamination.

Nothing outside this subpackage imports it.
"""
