"""Training-data operators: scoring, near-duplicate search, mixing, decontamination and token files."""
