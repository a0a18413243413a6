"""Relational, graph and rule operators."""
