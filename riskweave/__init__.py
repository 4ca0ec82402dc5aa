"""riskweave: Spark-first analytics for polygenic-style risk scores."""
