"""Training-data operators: scoring, decontamination, deduplication, tokenising and packing.

Each module holds one operator with its own general interface; ``queries`` registers
the thin ``opN_<name>`` queries over the driver's tables.  Nothing outside this
subpackage imports it.
"""
