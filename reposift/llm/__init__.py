"""Training-data operators: fingerprints, language, near copies, tokens, fixity, mixing, licences, personal data."""
