"""Column functions: text, frame features and pipeline events."""
