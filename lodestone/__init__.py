"""Lodestone: crawl, extraction, matching and corpus analytics on Spark."""
