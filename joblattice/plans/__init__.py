"""Whole jobs: the feed, exports, and the queries bound to the given tables."""
