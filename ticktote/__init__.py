"""Market and race analytics as PySpark DataFrame operators."""
