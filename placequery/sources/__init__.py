"""Readers, writers and the text formats around them."""
