"""Journey analytics on Spark: graphs, routing, joins and projections of append-only journeys."""
