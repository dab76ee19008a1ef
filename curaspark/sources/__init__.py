"""Listing, scanning and artifact access."""
