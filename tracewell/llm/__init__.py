"""Training-data operators: scoring, tokenising, filtering and deduplicating documents at corpus scale.

Nothing else in the library imports this subpackage.
"""
