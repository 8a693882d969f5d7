"""A Spark-native engine for player-level time series, participation counts and lineup search."""
