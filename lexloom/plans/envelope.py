"""One shape for every answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lexloom.errors import IncompleteFacts, InvalidRequest, ManualAction, SourceUnavailable, UnsupportedLanguage
from lexloom.session import durable

SUCCESS, NOT_FOUND, INCOMPLETE, UNSUPPORTED, MANUAL, UNAVAILABLE, ERROR = STATES = (
    "success", "not_found", "incomplete", "unsupported_language", "manual_action_required", "unavailable", "error",
)


@dataclass(frozen=True)
class Answer:
    """Outcome of an operation; ``data`` is None unless it succeeded or found nothing."""

    operation: str
    status: str
    message: str
    data: DataFrame | None = None
    details: dict[str, object] = field(default_factory=dict)


def answer(operation: str, build: Callable[[], DataFrame], settle: bool = False) -> Answer:
    """Build a plan; what goes wrong while it is built becomes a status.

    An unavailable source is never an empty result. The data is lazy; with ``settle`` it is worked out once, written to the
    shared folder and read from there, and an answer without rows is not_found.
    """
    try:
        data = build()
        if settle:
            data = durable(data)
            if data.isEmpty():
                return Answer(operation, NOT_FOUND, "nothing was found", data)
        return Answer(operation, SUCCESS, "", data)
    except IncompleteFacts as lacks:
        return Answer(operation, INCOMPLETE, str(lacks), details={"facts": lacks.facts})
    except UnsupportedLanguage as other:
        return Answer(operation, UNSUPPORTED, str(other))
    except ManualAction as by_hand:
        return Answer(operation, MANUAL, str(by_hand), details={"where": by_hand.where})
    except SourceUnavailable as gone:
        return Answer(operation, UNAVAILABLE, str(gone))
    except InvalidRequest as bad:
        return Answer(operation, ERROR, str(bad))
