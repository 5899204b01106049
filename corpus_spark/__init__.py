"""Corpus analytics on Spark: cleaning, windows, lexicons, sampling, coding, retrieval, records, runs."""
