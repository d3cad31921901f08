"""Rows that every operator on documents must stand."""

LINE = "This is a line of more than forty characters, shared."
NEAR = " ".join(f"word{i}" for i in range(120))

#: (doc_id, text): nulls, empty and white texts, ties, repeated rows, copies, near copies and a very long text.
NASTY = [
    (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "one"), (4, "one"), (None, "no id at all"), (5, "x" * 100_000), (6, "a b " * 30_000),
    *[(10 + i, f"{LINE}\nown line {i}\n{LINE.upper()}  ") for i in range(7)],
    (20, NEAR), (21, NEAR + " tail"), (22, "Été 中文 \U0001f600\nz"), (23, "\n\n"), (24, NEAR), (25, "bad\x00zero"),
]


def nasty(spark):
    """`documents` of the rows above, with other columns whose names the operators use too."""
    names = "key size n fp cell pos _d _t _drop _n _turn _text kept n_lines n_dropped drop taken turn component_id row met".split()
    rows = [(d, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), *["x"] * len(names)) for i, (d, t) in enumerate(NASTY)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
