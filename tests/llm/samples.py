"""Small frames with the awkward rows every operator has to bear."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

SYLLABLES = ["an", "be", "cor", "del", "é", "fin", "gro", "ha", "in", "jo", "ka", "ß", "lu"]


def prose(seed: int, words: int) -> str:
    """Sentences and lines of invented words."""
    pick = random.Random(seed)
    out = []
    for i in range(words):
        word = "".join(pick.choice(SYLLABLES) for _ in range(pick.randint(1, 4)))
        end = pick.random()
        out.append(word + ("." if end < 0.08 else "," if end < 0.12 else ""))
        out.append("\n" if end < 0.05 else " ")
    return "".join(out).strip()


def documents() -> list[tuple]:
    """Null and empty texts, a long one, copies, near copies, null and repeated ids."""
    texts = [
        None,
        "",
        " \n\t ",
        "Word",
        "two words",
        "one two three",
        prose(1, 60),
        prose(1, 60),  # a copy
        prose(2, 80),
        prose(2, 80) + " more",  # a near copy
        prose(3, 4000),  # long
        "same line\n" * 40,
        "A B C D e f g. " * 30,
        "a" * 700,  # one word, repeats itself
        "<p> | *** #$% &|<> " * 20,
        "日本語 텍스트   x y \x1c z 'S İstanbul don't <|endoftext|>",
        prose(4, 100),
    ]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[6])  # a repeated row
    rows.append((None, prose(5, 70), None, None, None))
    rows.append((None, None, None, None, None))
    rows.append((4, prose(6, 55), "en", "src0", 5))  # an id a second time
    return rows


def frame(spark, rows=None, parts: int = 3):
    rows = documents() if rows is None else rows
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(parts)
