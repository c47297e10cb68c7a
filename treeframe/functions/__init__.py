"""Column functions: every argument and result is a Spark Column."""
