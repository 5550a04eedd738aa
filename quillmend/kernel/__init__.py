"""Character-level work in plain Python; no Spark here."""
