"""Errors: those that end a run, and the one of a single row."""

from __future__ import annotations


class CurationError(Exception):
    pass


class ConfigurationError(CurationError):
    pass


class DependencyError(CurationError):
    pass


class ModelLoadError(CurationError):
    pass


class ArtifactError(CurationError):
    pass


class FatalPipelineError(CurationError):
    pass


class RowError(CurationError):
    """A row that fails is data: its code and stage go to the failure table."""

    def __init__(self, code: str, stage: str, message: str = ""):
        super().__init__(message or code)
        self.code, self.stage = code, stage
