"""Graph, text, vector and quality analytics expressed as Spark plans."""
