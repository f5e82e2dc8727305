"""Text-index analytics on Spark: suffix arrays, BWT navigation, search, mining, sequences and approximate matching."""
