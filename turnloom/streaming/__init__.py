"""Streams of turns: networks kept up to date as scenes arrive."""
