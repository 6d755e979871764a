"""Training-data operators: dedup, quality, archives, chat, search, packing, counting.

Nothing else in the library imports this subpackage; ``catalog`` lists its
queries for the driver's entry point.
"""
