"""Training-data operators: ten independent DataFrame operators for large text corpora."""
