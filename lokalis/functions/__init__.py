"""Column functions: text, numbers, places, classification."""
