"""Legal-corpus analytics as composable PySpark DataFrame operators."""

from lexloom.errors import (
    CorpusNotSynced,
    InvalidRequest,
    SourceUnavailable,
)

__all__ = ["CorpusNotSynced", "InvalidRequest", "SourceUnavailable"]
