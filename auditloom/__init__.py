"""Audit many source repositories as Spark jobs: facts, rules, review, findings, reports."""
