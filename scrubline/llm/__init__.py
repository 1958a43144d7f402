"""Training-data operators: language id, search, similarity joins, filters,
scans, classifiers, language models, tokenisation, decontamination, dedup."""
