"""tessera: a PySpark-native engine for question-answering and fine-tuning data."""
