"""offerlake: supplier offers and order confirmations as Spark tables."""
