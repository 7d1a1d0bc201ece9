"""Column functions: text, vectors, JSON, paths and prompts."""
