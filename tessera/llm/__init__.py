"""Training-data operators: extraction, quality, deduplication, mixing, packing and token output.

Nothing outside this subpackage imports it.  ``queries`` holds the thin
contract queries; every operator keeps its own general interface in its module.
"""
