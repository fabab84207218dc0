"""Line-based corpus and feature file formats: readers (S1-S9) and writers (K1-K8)."""

from wordloom.sources.readers import *  # noqa: F401,F403
from wordloom.sources.writers import *  # noqa: F401,F403
