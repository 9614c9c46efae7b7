"""Operators that prepare training text: one module each, the registered queries in ``queries``."""
