"""Texts with nulls, ties, repeats and extremes."""

PROSE = " ".join(f"w{n % 97}x{n * n % 61}" for n in range(180))


def edge_texts():
    """(doc_id, text) with nulls, empty and long texts, ties, repeated rows, and passages in common."""
    middle = " ".join(PROSE.split()[40:110])
    rows = [
        (1, PROSE),
        (2, None),
        (3, ""),
        (4, " \t\n "),
        (5, "one two three"),
        (6, "one two three"),
        (7, PROSE + " and a tail"),
        (8, "a lead " + middle + " then other words " + " ".join(f"q{n}" for n in range(80))),
        (9, PROSE),
        (9, PROSE),
        (10, "word " * 30000),
        (11, " ".join(f"z{n}" for n in range(30000)) + " " + middle),
        (12, "mail bob.7@mail3.example.com or +1 (132) 555-1352 from 10.0.0.255, card 4845168114407329; é 😀 x@y.z"),
        (13, "Line\nLine\nother line\nLine\n\n\n"),
        (14, "é" * 5000),
        (15, middle),
        (16, middle),
    ]
    return rows
