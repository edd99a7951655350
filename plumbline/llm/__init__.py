"""Operators that prepare corpora for training language models. Nothing else in the library imports them."""
