"""Registered queries over the derived molecule tables and their SQL."""
