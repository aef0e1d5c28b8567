"""Catalog, statements and the SQL front end."""
