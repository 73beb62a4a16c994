"""medlark: Spark-native drug-safety analytics (cohorts, disproportionality, doses, graphs)."""
