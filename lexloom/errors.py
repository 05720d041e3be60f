"""Typed failures.

A missing source raises; an empty DataFrame always means "looked and found
nothing".
"""


class SourceUnavailable(RuntimeError):
    """A source cannot be consulted at all."""


class CorpusNotSynced(SourceUnavailable):
    """No local metadata exists for the requested scope."""


class InvalidRequest(ValueError):
    """A parameter is outside its allowed values."""


class IncompleteFacts(InvalidRequest):
    """Facts that an answer needs are missing; ``facts`` names them."""

    def __init__(self, message: str, facts: list[str]):
        super().__init__(message)
        self.facts = facts


class UnsupportedLanguage(InvalidRequest):
    """A language for which there are no texts."""


class ManualAction(SourceUnavailable):
    """What is asked for can only be had by hand, at ``where``."""

    def __init__(self, message: str, where: str):
        super().__init__(message)
        self.where = where
