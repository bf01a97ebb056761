"""PySpark-native evidence matching: parse, retrieve, judge, aggregate, rank."""
