"""Column functions: text preparation, similarity measures, phonetic codes."""
