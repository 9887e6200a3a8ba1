"""A property-graph analytics engine for source code and other linked data, on Spark."""
