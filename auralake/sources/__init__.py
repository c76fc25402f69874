"""Readers, writers and resolvers."""
