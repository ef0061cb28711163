"""Training-data operators: near-duplicates, archives, filters, mixing, counting and scanning.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
