"""Analytics over project memory, as Spark plans."""
