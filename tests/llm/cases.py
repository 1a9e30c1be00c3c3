"""Documents with the awkward cases that every operator must take, and helpers for brute-force versions."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, gone string, _row0 int"


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n=8):
    vocabulary = "ready stone river cold bright evening market letter window garden silver quiet".split()
    return " ".join(rng.choice(vocabulary) + rng.choice(("", "s", "ly", "er", "ing")) for _ in range(n)).capitalize() + "."


def texts():
    """Texts by id: ordinary ones, exact and near copies, shared passages, and odd ones."""
    rng = random.Random(5)
    made = ["\n".join(" ".join(sentence(rng, rng.randint(3, 12)) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 5)))
            for _ in range(40)]
    passage = " ".join(sentence(rng, 9) for _ in range(8))
    made += [made[0], made[0], made[1] + " One more word here.", made[2].replace("river", "lake", 1)]
    made += [f"{sentence(rng)}\n{passage}\n{sentence(rng)}" for _ in range(5)]
    base = [rng.choice(("alpha", "beta", "gamma", "delta")) + str(rng.randint(0, 400)) for _ in range(120)]
    for k in range(12):
        copy = list(base)
        for _ in range(k):
            copy[rng.randrange(120)] = f"x{rng.randint(0, 999)}"
        made.append(" ".join(copy))
    made += ["", None, " \n\t \n", "a", "a b", "a b", "x" * 700, "ab" * 300, "Äé ß　日本語 \U0001F600" * 9, "12 34 !!", "The the THE the " * 40,
             "line one\nline one\n\nline one\nother", (passage + "\n") * 60, "\x00 nul \x0b tab\x0cfeed"]
    return made


def rows(repeat=True):
    found = [(k, t, (None, "en", "de")[k % 3], f"s{k % 2}" if k % 5 else None, len(t) if t is not None else None, 0.5, "g", 1)
             for k, t in enumerate(texts())]
    if repeat:
        found += [found[3], found[3], found[44]]
    return found


def documents(spark, found=None):
    return spark.createDataFrame(rows() if found is None else found, SCHEMA).repartition(5)
