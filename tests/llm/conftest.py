from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    """Short texts with copies, near copies, shared passages, nulls, blanks, repeats of one word and a long one."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeé ñü"[:7]) for _ in range(draw.randint(1, 7))) for _ in range(400)]
    words = lambda k: " ".join(draw.choice(vocabulary) for _ in range(k))
    passage = words(90)
    out: list[str | None] = [None, "", "  \n\t ", "one", "a a a a a a a a a a a a a a a a a a a a", "x" * 1500, "Ünïcödé  and\x0bvertical"]
    for k in range(n):
        kind = draw.randrange(5)
        if kind == 0 and len(out) > 10:
            out.append(draw.choice(out[7:]))
        elif kind == 1 and len(out) > 10:
            own = (draw.choice([t for t in out[7:] if t]) or "").split(" ")
            own[draw.randrange(len(own))] = "changed"
            out.append(" ".join(own))
        elif kind == 2:
            out.append(words(draw.randint(0, 60)) + " " + passage + "\n" + words(draw.randint(0, 60)))
        else:
            out.append(words(draw.randint(1, 200)))
    out.append(" ".join(words(300) for _ in range(10)))
    return out


@pytest.fixture
def docs(spark):
    rows = [(i * 3 % 101, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def odd_docs(spark):
    """Null ids, repeated ids and rows, and columns with clashing names."""
    rows = [(None, "null id " * 80, 1, "k"), (None, None, None, None), (7, "same " * 120, 2, "k"), (7, "same " * 120, 2, "k"), (7, "other text", 3, None), (8, "same " * 120, 4, "x"), (9, "", 5, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, fp long, kept string")
