"""DataFrame operators: detect, extract, filter, redact, match, score, compare."""
