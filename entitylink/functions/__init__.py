"""Column functions: text cleaning, tracks, normalised keys and stems."""
