"""tessera: a Spark-native engine for temporal, evidence-bearing knowledge graphs and corpus preparation."""
