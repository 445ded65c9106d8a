"""Verification operators over DataFrames of cases."""
