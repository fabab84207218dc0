"""Column-level functions (tokenisers, n-grams, text normalisation)."""

from wordloom.functions.tokens import *  # noqa: F401,F403
