"""Functions over code texts that have no counterpart among Spark's own."""
