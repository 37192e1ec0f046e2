"""Whole jobs built from the operators: feature builds, dataset building, scoring, leaderboards, models."""
