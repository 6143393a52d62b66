"""Corpus analytics on Spark: sources, cleaning rules, deduplication, sampling, contracts and statistics as DataFrame plans."""
