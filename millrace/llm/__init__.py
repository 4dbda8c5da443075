"""Training-data pipeline operators.

Ten operators (mixing, SimHash near-dedup, HTML extraction, license scans, quality and
toxicity classifiers, URL filters, benchmark decontamination, sharding, embedding
near-dedup) and their registered queries.  Nothing outside this package imports it.
"""
