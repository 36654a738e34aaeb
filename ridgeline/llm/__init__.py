"""Training-data operators: decontamination, near duplicates, language, tokens, URLs, toxicity, PII, repeats, quality, BPE."""
