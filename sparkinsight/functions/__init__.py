"""Reusable Column expressions and small fitted-statistics helpers."""
