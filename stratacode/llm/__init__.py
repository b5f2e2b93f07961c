"""Training-data operators: near-dedup, formatting, tokenising, media, mixing, packing and archives.

Nothing outside this subpackage imports it.
"""
