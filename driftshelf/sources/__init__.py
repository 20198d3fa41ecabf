"""Inputs: tables, saved pages, observation files."""
