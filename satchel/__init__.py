"""satchel: a PySpark-native engine for message stores."""
