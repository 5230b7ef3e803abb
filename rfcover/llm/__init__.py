"""Corpus operators for training data, over the texts that feature and radio records carry."""
