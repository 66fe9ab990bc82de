"""Operators over DataFrames: change capture, diff, risk rules, gate, index, audit and workflow."""
