"""Customer-feedback and conversation analytics as Spark DataFrame operators."""
