"""Operators on free text and record groups: matching, grouping, survivorship, repair, tokenising, leakage, shared spans.

Nothing outside this subpackage imports it.
"""
