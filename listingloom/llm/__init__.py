"""Operators for preparing training data at scale, apart from the catalogue: nothing else in the library imports them."""
