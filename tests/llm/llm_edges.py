"""Hand-made rows every operator has to take."""

LONG = " ".join(f"word{i % 977} of line {i}." for i in range(6000))
PROSE = ("The committee met on Tuesday to talk about the bridge over the river, and nobody could say who had "
         "paid for the first survey. Several members asked for the maps again, since the older ones showed a "
         "mill where the new road ends and two houses that were never built at all by the county.")
TEXTS = [PROSE, PROSE, None, "", " \t\n ", "a", "...!!", "é ́İΣ ß日本 😀", LONG, PROSE + " Tail.", "x" * 900, None, PROSE]


def frame(spark, texts=TEXTS, extra=True):
    """Rows with a null id, a repeated row, and columns named like internal ones."""
    rows = [(i if i != 5 else None, t, "en", i % 3) for i, t in enumerate(texts)]
    if len(rows) > 1:
        rows.append(rows[1])
    cols = "doc_id long, text string, lang string"
    if not extra:
        return spark.createDataFrame([r[:3] for r in rows], cols)
    rows = [(*r, 1, "k", 7) for r in rows]
    return spark.createDataFrame(rows, cols + ", n int, _row int, spans string, block int")


def empty(spark):
    return frame(spark).limit(0)
