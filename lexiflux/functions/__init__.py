"""Column functions: text normalisation, tokens, counts, ratios, HTML."""
