"""Flows made of operators."""
