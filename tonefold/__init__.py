"""Spark-native analytics of earnings calls: text signals, forward returns, long/short backtests."""
