"""cairn: a PySpark-native engine for document ETL, relational modelling and retrieval."""
