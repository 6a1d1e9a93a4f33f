"""What a rejected filter raises."""


class FilterError(ValueError):
    """A filter that breaks the language's rules: the keyword at fault, the path to it, a message that begins with it."""

    def __init__(self, message: str, keyword: str | None = None, path: str | None = None) -> None:
        super().__init__(f'"{path}": {message}' if path else message)
        self.keyword, self.path = keyword, path
