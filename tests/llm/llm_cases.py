"""Documents that every operator must get over."""

#: Texts that every operator must get over: null, empty, blank, marks only, ties, repeats, long words, other scripts.
PROSE = "The quick brown fox jumps over the lazy dog while seven wise owls watch from a tall old oak near the river bank at dusk"
HARD = [
    (1, PROSE + " and then they sleep until the morning light comes back again.", "en"),
    (2, PROSE + " and then they sleep until the morning light comes back again.", "en"),
    (3, PROSE.replace(" ", "  ") + " and then they sleep until the morning light comes back again.", "en"),
    (4, None, "en"),
    (5, "", None),
    (6, " \t\n", "en"),
    (7, "!!! ??? ...", "de"),
    (8, "one two", "en"),
    (9, "One two", "en"),
    (10, ("wort " * 300 + "Größe Straße über\n") * 3, "de"),
    (11, "x" * 3000 + " " + "ab" * 700, None),
    (12, "日本語のテキスト ▁ été \U0001f600 </s><s>[INST] \x00 don't  I'll go\r\n\t 12345 ½²", "fr"),
    (13, PROSE.upper(), "en"),
    (14, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a", "en"),
    (None, PROSE + " and then they sleep until the morning light comes back again.", "en"),
]


def texts():
    return {i: t or "" for i, t, _ in HARD}
