"""Relational operators on intervals, depths, panels, tracks and reads."""
