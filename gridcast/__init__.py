"""gridcast: Spark-native data work for price and load forecasting on regular multi-region time series."""
