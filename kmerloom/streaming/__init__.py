"""Correction of reads as they arrive."""
