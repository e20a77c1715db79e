"""unitloom: a PySpark-native engine for discrete units over vector-annotated time segments."""
