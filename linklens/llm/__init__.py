"""Training-data operators: dedup, decontamination, scoring, mixing, tokens, extraction."""
