"""Errors that operators raise before a plan runs."""


class ArrayError(ValueError):
    """Base of the errors below."""


class RankError(ArrayError):
    """An argument has too few or too many axes."""


class ShapeError(ArrayError):
    """Shapes don't agree."""


class DomainError(ArrayError):
    """A value lies outside what an operator takes."""


class FillError(ArrayError):
    """A fill is needed and not known."""
