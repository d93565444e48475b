"""Readers and adapters that turn raw tables into element tables."""
