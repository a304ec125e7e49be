"""Vendor-operations analytics as DataFrame-to-DataFrame transformations."""
