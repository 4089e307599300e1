"""Failures as exceptions with a status code."""

from __future__ import annotations

from enum import IntEnum


class Code(IntEnum):
    """Fixed values."""

    OK = 0
    NOT_FOUND = 1
    ALREADY_EXISTS = 2
    INVALID_ARGUMENT = 3
    PERMISSION_DENIED = 4
    FAILED_PRECONDITION = 5
    RESOURCE_EXHAUSTED = 6
    UNAVAILABLE = 7
    INTERNAL_ERROR = 8
    NOT_SUPPORTED = 9
    UNKNOWN = 10


class EngineError(Exception):
    code = Code.UNKNOWN

    def __str__(self) -> str:
        return f"{self.code.name}: {super().__str__()}"


def _kind(name: str, code: Code) -> type[EngineError]:
    return type(name, (EngineError,), {"code": code, "__doc__": code.name})


NotFound = _kind("NotFound", Code.NOT_FOUND)
AlreadyExists = _kind("AlreadyExists", Code.ALREADY_EXISTS)
InvalidArgument = _kind("InvalidArgument", Code.INVALID_ARGUMENT)
PermissionDenied = _kind("PermissionDenied", Code.PERMISSION_DENIED)
FailedPrecondition = _kind("FailedPrecondition", Code.FAILED_PRECONDITION)
ResourceExhausted = _kind("ResourceExhausted", Code.RESOURCE_EXHAUSTED)
Unavailable = _kind("Unavailable", Code.UNAVAILABLE)
InternalError = _kind("InternalError", Code.INTERNAL_ERROR)
NotSupported = _kind("NotSupported", Code.NOT_SUPPORTED)
