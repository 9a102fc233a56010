"""Errors that callers see. Their texts are part of the interface."""


class VectorError(ValueError):
    """A request, mapping or vector that can't be used."""


class NotFound(LookupError):
    """A pointer to a vector that isn't there."""


class ParseError(VectorError):
    """JSON of another form than expected."""


def wrong_dimensions(actual: int, expected: int) -> VectorError:
    return VectorError(f"Expected dimension {expected} but got {actual}")
