"""Counts that go on while reads arrive."""
