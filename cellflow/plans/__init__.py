"""Registered queries; importing the package registers all of them."""

from . import learning, registry, round_trips  # noqa: F401
