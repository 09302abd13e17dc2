"""Operators that prepare training text at scale. Nothing outside this folder imports it."""
