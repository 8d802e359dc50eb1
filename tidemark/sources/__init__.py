"""Readers and writers of series, vintages, surveys, release calendars and results."""
