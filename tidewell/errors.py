"""What can go wrong, by the status a service would answer with."""

from __future__ import annotations


class SeriesError(Exception):
    status = 500


class SeriesNotFound(SeriesError):
    status = 404


class BadRequest(SeriesError):
    status = 400


class Conflict(SeriesError):
    status = 409


class CorruptCommit(SeriesError):
    """No valid commit is left of a series that had one."""
