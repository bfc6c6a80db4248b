"""Corpusloom: functions."""
