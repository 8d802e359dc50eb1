"""Relational operators of the engine: plans that Catalyst optimises."""
