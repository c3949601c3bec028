"""Registered queries (importing this package registers them all) and the engine built on the operators."""

from . import catalog, records, stored  # noqa: F401
