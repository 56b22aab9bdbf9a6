"""leakloom: Spark-native secret-exposure analytics."""
