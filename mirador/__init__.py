"""mirador: Spark-first record analytics for safety-aware visual question answering."""
