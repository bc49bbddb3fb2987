"""Shared plan pieces: session settings, skew handling, saved results, registered queries."""
