"""A property-graph analytics engine on PySpark."""
