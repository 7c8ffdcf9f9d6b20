"""A Spark-native engine for crawl state, content analytics and corpus preparation."""
