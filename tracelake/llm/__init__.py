"""Training-data operators: dedup, packing, filters, joins and sharding.

Nothing else in the library imports this subpackage; ``queries`` and
``oracles`` are what the entry module registers.
"""
