"""Operators for preparing training text: ten corpus jobs and their queries."""
