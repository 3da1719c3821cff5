"""The rows that edge tests share."""

LONG = " ".join(f"w{k % 977}x{k // 977}" for k in range(60_000))
SHARED = " ".join(f"s{k}" for k in range(60))
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t  "),
    (4, "a"),
    (5, "a"),
    (5, "a"),
    (None, "One two three four five six seven eight."),
    (None, None),
    (7, LONG),
    (8, LONG + " end"),
    (9, f"before {SHARED} after"),
    (10, f"{SHARED} and more words follow here"),
    (11, "ÉÀ 漢字 ß 😀 don't 'll 12٣  x"),
    (12, "12345 !!! ..."),
    (13, "One two three four five six seven eight."),
    (14, "A\u0000B \u2028 mail a.b@c.de +1 (743) 555-3824 4111 1111 1111 1111 10.0.0.256 10.0.0.25"),
]
