"""Corpusloom: Spark-native suffix analytics for collections of similar strings."""
