"""Training-data operators: near-duplicate removal, filtering, token files and packing.

Nothing outside this subpackage imports it, so the folder can be removed as a whole.
"""
