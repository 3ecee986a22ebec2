"""Part of tidemark; see README.md."""
