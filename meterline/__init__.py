"""Usage and cost analytics for AI-assistant session logs, as Spark DataFrame operators."""
