"""Training-data operators: licences, near duplicates, personal data, leaks, packing, URL lists, quality, toxicity, tokens, fingerprints.

Nothing outside this package (and the pipeline script that belongs to it) imports it.
"""
