"""plumbline: a Spark-native engine for website-audit analytics and corpus preparation."""
