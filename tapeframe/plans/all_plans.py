"""Imports every plan module so that its queries register."""

from . import brokers, evaluate, fundamentals, primitives, report, screens, signals, study, tables  # noqa: F401
