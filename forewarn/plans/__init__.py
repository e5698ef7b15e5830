"""Compositions of operators: audits, experiments and the registered queries."""
