"""Column functions: chapters, texts, metrics."""
