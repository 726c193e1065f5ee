"""Corpus analytics on Spark: cleaning, dedup, lexicon mining, vocabularies, splits and LM metrics as DataFrame plans."""
