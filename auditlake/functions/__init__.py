"""Column functions: field extraction, classification, fingerprints, ignore list."""
