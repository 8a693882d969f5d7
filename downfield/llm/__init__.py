"""Operators for preparing training text: decontamination, toxicity, secrets, tokens, PII, duplicates, HTML and quality."""
