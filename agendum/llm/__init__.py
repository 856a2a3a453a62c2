"""Training-data operators: packing, decontamination, toxicity, n-gram Jaccard
join, sharding, license scans, line dedup, PII, URL filters, exact top-k search,
source divergence, suffix dedup and whitening. One module per operator; ``queries.py`` registers one query each.

Nothing else in the package imports this subpackage.
"""
