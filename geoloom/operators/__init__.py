"""Spatial joins, searches, viewports, profiles and extraction over tables of buildings, streets and areas."""
