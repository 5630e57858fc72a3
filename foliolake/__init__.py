"""foliolake: document-text analytics as composable Spark DataFrame operators."""
