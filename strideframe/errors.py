"""Errors with the meaning of the operator that raises them."""


class FrameError(Exception):
    """Any error of the engine."""


class AlignmentError(FrameError):
    """A sequence can't be aligned with its model."""


class CodebookError(FrameError):
    """A model registry lacks what is asked for."""


class DataSetError(FrameError):
    """A data set is unusable."""


class EvaluationError(FrameError):
    """A model can't be evaluated."""


class InvalidFormatError(FrameError):
    """A file isn't in its format."""


class LanguageModelError(FrameError):
    """A language model is unusable."""


class MalformedParameterError(FrameError, ValueError):
    """A parameter string can't be read."""


class OutOfVocabularyError(FrameError, KeyError):
    """A word isn't in the lexicon."""


class TrainingError(FrameError):
    """An estimate isn't possible."""
