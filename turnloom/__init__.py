"""turnloom: a PySpark-native engine for timed, speaker-labelled transcripts and interaction networks."""

__version__ = "0.1.0"
