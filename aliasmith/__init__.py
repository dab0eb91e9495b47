"""Entity linking over queries and short texts, and the mining of its statistics, on Spark."""
