"""Queries over whole tables, and the SQL they are held against."""
