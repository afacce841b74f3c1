"""Errors of the engine."""


class EngineError(Exception):
    """A statement that can't be carried out."""


class SyntaxProblem(EngineError):
    """A statement that can't be read; span is (line, column) of where reading stopped."""

    def __init__(self, message: str, span: tuple[int, int]):
        super().__init__(f"[{span[0]}:{span[1]}] {message}")
        self.span = span
