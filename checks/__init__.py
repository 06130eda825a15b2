"""Registered queries, the fixtures they read, and the SQL that checks them."""
