"""Corpus operators for training data: media, chat repair, mixing, language
identification, vector search, packing, near duplicates, toxicity and repeated spans."""
