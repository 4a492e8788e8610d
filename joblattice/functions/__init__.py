"""Column functions: text, classification, places, cycles, dates, identity."""
