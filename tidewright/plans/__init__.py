"""Declarative specifications (rules, mappings, catalogs) that operators compile into plans."""
