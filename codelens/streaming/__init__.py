"""Scoring, statistics and the high-score list kept up to date as rows arrive."""
