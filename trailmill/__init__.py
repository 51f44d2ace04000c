"""trailmill: mobility analytics on Spark (tracks, roads, trips, heat maps) and, apart from it, training-data jobs in ``llm``."""
