"""Registered queries and the pipelines that compose operators."""
