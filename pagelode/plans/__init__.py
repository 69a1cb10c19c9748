"""Whole plans: rule scores, context scores, and arbitration between rules and model."""
