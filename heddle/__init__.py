"""Graph-dataflow and finding analytics on Spark."""
