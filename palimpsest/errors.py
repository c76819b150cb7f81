"""Errors that callers tell apart."""


class PalimpsestError(Exception):
    """Any error of the engine."""


class EmptyPattern(PalimpsestError):
    def __init__(self):
        super().__init__("the search pattern is empty")


class InvalidPattern(PalimpsestError):
    pass


class NoArchives(PalimpsestError):
    pass


class ScopeError(PalimpsestError):
    """Service and account are missing, half given, not inferable or not allowed."""


class ConfigError(PalimpsestError):
    """A setting that is unknown or has a wrong value."""


class SourceError(PalimpsestError):
    """An input that no reader takes, or that is broken."""


class BrokenInputs(SourceError):
    """Inputs of an ingest that a reader took and couldn't read; nothing is written."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


class ArchiveError(PalimpsestError):
    """An archive that isn't there, has another version, or doesn't hold what its manifest says."""


class CompressError(PalimpsestError):
    """A file that can't be compressed or decompressed."""


class RequestError(PalimpsestError):
    """A request whose form or media type isn't understood."""
