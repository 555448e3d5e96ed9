"""What callers see: a status, a code and whether a retry can help."""

from __future__ import annotations


class EngineError(Exception):
    status, code, retryable = 500, "internal", True
    table_scoped = splittable = False  # of one table only; may pass in smaller parts

    def __init__(self, message: str = "", **detail):
        super().__init__(message or self.code)
        self.detail = detail


class Invalid(EngineError):
    status, code, retryable = 400, "invalid", False


class Rejected(EngineError):
    """The storage engine refuses the statement or a value."""

    status, code, retryable = 400, "rejected", False


class LimitExceeded(EngineError):
    status, code, retryable = 400, "limit_exceeded", False


class Unauthorized(EngineError):
    status, code, retryable = 401, "unauthorized", False


class Forbidden(EngineError):
    status, code, retryable = 403, "forbidden", False


class NotFound(EngineError):
    status, code, retryable = 404, "not_found", False


class UnsupportedFormat(EngineError):
    status, code, retryable = 415, "unsupported_format", False


class Unavailable(EngineError):
    status, code, retryable = 503, "unavailable", True


class QueueFull(Unavailable):
    code = "queue_full"


class InFlight(Unavailable):
    code = "in_flight"


class Denied(Unavailable):
    """The engine's own access is refused, which is no fault of the request."""

    code, table_scoped = "denied", True


class EmptyProjection(EngineError):
    """Nothing was asked for; the answer is an empty list."""

    status, code, retryable = 200, "empty", False


def missing(text: str) -> Unavailable:
    error = Unavailable(text)
    error.table_scoped = True
    return error


def from_spark(error: Exception) -> EngineError:
    """Map what Spark raises: analysis, parse, cast and arithmetic errors are the caller's, missing files and lost jobs are not."""
    name, text = type(error).__name__, str(error)
    if isinstance(error, EngineError):
        return error
    if name in ("AnalysisException", "ParseException", "NumberFormatException", "ArithmeticException", "DateTimeException", "IllegalArgumentException") or "CAST_INVALID_INPUT" in text or "[DIVIDE_BY_ZERO]" in text:
        return missing(text) if "PATH_NOT_FOUND" in text else Rejected(text)
    if "cancelled" in text and "time limit" in text:
        return LimitExceeded(text)
    if "AccessControlException" in text or "Permission denied" in text:
        return Denied(text)
    if "OutOfMemoryError" in text or "maxResultSize" in text:
        error = Unavailable(text)
        error.splittable = True
        return error
    if "FileNotFound" in text or "ExecutorLost" in text or "Job aborted" in text:
        return Unavailable(text)
    return EngineError(text)
