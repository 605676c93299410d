"""Spark-first urban-form analytics: geometry in DataFrame columns, spatial joins as cell equi-joins."""
