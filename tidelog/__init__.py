"""tidelog: leakage-safe analytics over timestamped, labelled event logs on Spark."""
