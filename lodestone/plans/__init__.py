"""Whole pipelines: crawls, career scans, matching reports."""
