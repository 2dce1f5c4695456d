"""Readers, writers and dimensions: test tables and the DNS stand-in, bronze, lake layout, rules."""
