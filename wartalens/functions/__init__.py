"""Column functions: text cleaning, tokens, stemming, HTML and array helpers."""
