"""Evidence analytics as composable PySpark DataFrame operators."""
