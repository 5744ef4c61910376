"""Operators for training data: distinct counts, percentiles, leaked evaluation texts, mixtures and look-alike texts."""
