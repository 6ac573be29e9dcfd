"""Recommenders and the pair ranker."""
