"""Binding of the clinic data model to a star schema, queries and their SQL twins."""
