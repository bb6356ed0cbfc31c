"""Rows that every operator has to take."""

HARD = [
    (None, None), (1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (5, "a b"), (6, "x" * 30_000), (7, "word " * 20_000),
    (8, "same words here stand twice in two rows of this table"), (8, "same words here stand twice in two rows of this table"),
    (9, "same words here stand twice in two rows of this table"), (10, "ünï 中文 \U0001f642 ▁ \x00 ​"),
    (11, "12345678901234567890123456789012345"), (12, "+" * 50 + "@" * 50 + "." * 50),
]
