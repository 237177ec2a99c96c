"""Rows that every text operator must take."""

# Missing and empty texts, missing and repeated ids, equal rows, one very long text without a space.
ODD = [
    (None, None),
    (None, "one two three four five six seven"),
    (1, ""),
    (2, "  \t\n"),
    (3, "One two three four five six seven"),
    (3, "One two three four five six seven"),
    (3, "another text under the same id, which is not the same text at all"),
    (4, "a" * 200_000),
    (5, "é" * 1000 + " 中文 😀 <|endoftext|> don't"),
    (6, None),
]
