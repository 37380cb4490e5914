"""readloom: Spark-native read trimming, genomic intervals and training-data preparation."""
