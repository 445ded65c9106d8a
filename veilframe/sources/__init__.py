"""Tables of cases in and out."""
