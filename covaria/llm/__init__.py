"""Operators for preparing training text; nothing else in covaria imports this subpackage."""
