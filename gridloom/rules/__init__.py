"""Declarative range rules: catalog, compiler with two back ends, selection, checks and fitting."""
