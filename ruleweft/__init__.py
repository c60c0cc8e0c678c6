"""A PySpark-native engine for declarative rules over DataFrames of facts."""
