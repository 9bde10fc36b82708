"""Readers, writers and scratch tables."""
