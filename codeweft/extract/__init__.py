"""Source text to program elements and edges: one extractor per language and a table function over all."""
