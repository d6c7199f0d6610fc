"""Contact directories from recorded sources, as Spark plans."""
