"""Code-graph analytics on Spark: extraction, resolution, graph and vector queries over source trees."""
