"""Verification of a stream of cases."""
