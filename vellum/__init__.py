"""A document evidence engine on Spark: pages, words, candidates and decisions as tables."""
