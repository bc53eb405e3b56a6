"""Queries on the driver tables; importing a module registers its queries."""
