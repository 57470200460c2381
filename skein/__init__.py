"""skein: similarity networks, cleaning and measurement analytics for large series collections on Spark."""
