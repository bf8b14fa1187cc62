"""corpuslens: a PySpark-native engine for labelled text and code corpora."""
