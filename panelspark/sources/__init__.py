"""Readers, writers and generated dimension tables."""
