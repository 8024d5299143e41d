"""Change-propagation analytics over versioned call graphs, as Spark tables."""
