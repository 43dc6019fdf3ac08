"""Reference-aligned statistical genetics on Spark."""
