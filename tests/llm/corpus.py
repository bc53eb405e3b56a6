"""Small corpora with the cases that every operator has to stand."""

import random
import re

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, node long, score double, row string, key int, comp int, copies int, kind string"
WORDS = "red stone river under the old bridge where quiet people sang about rain and light for many years until morning came again with bread".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies, clashing names."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [
        (1, base), (2, base.upper()), (3, near), (3, near), (4, None), (5, ""), (6, " \n\t "), (None, base), (None, None), (7, prose(2, 90)),
        (7, prose(3, 90)), (8, "one two"), (9, "ONE  two"), (10, "日本語" * 300), (11, prose(4, 60_000)), (12, "a" * 50_000), (13, "x, y!\n" * 400),
        (-5, prose(5, 30) + "\nReleased under the MIT License."), (2**62, "é ß ÀÉ straße"),
    ]
    return spark.createDataFrame([(i, t, None, "s", None, 1, 0.5, "r", 3, 4, 5, "k") for i, t in rows], DOCUMENTS)


def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


def shingles(text: str | None) -> frozenset:
    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[n:n + 5]) for n in range(len(words) - 4))
