"""Operations of a training-data pipeline: classifiers, token counting,
filters, near-duplicate detection, sharding, packing, search, extraction.

Nothing else in the library imports this package. ``queries`` registers one
query per operator; ``corpus_pipeline.py`` at the repository top chains five.
"""
