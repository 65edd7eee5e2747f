"""Whole plans: from a source tree to fact tables, diagrams and a README."""
