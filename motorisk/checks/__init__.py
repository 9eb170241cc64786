"""Query registrations, grouped by subject."""

from . import datasets, evaluation, extensions, features, models, profile, serving  # noqa: F401
