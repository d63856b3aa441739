"""Readers of feeds, posts, pages and replies."""
