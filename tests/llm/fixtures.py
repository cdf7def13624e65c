"""Small documents of every awkward kind."""

import random

from pyspark.sql import types as T

WORDS = "the of and stone river light house winter over under small great blue green bird field".split()

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def sentence(rng: random.Random, n: int) -> list[str]:
    return [f"{rng.choice(WORDS)}{rng.randrange(200)}" for _ in range(n)]


def edited(rng: random.Random, words: list[str], share: float) -> list[str]:
    return [f"edit{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def awkward_texts(seed: int = 5) -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, blanks, nulls, ties, repeats, and one long text."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randrange(3, 160)) for _ in range(40)]
    rows: list[tuple[int | None, str | None]] = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(40, 90):
        rows.append((i, " ".join(edited(rng, rng.choice(base), rng.choice([0, 0.01, 0.03, 0.1])))))
    passage = sentence(rng, 60)
    for i in range(90, 96):
        rows.append((i, " ".join([*sentence(rng, rng.randrange(30)), *passage, *sentence(rng, rng.randrange(30))])))
    near = sentence(rng, 200)
    for i in range(96, 126):
        rows.append((i, " ".join(edited(rng, near, rng.choice([0.005, 0.02, 0.04])))))
    rows += [(130, None), (131, ""), (132, " \t\n\x0b\x0c\r "), (133, "one"), (134, "One"), (135, "one two three four")]
    rows += [(136, "same text\n"), (137, "same  text"), (138, "sametext"), (136, "same text\n"), (None, "same text\n")]
    rows += [(139, "é中🙂 \x00 ￿ ß\u00a0x " * 5), (140, "word " * 4000), (141, " ".join(sentence(rng, 9000)))]
    return rows


def documents(spark, rows=None):
    rows = awkward_texts() if rows is None else rows
    full = [(i, t, "en" if k % 2 else None, None if k % 3 else "src", None) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCUMENTS).repartition(3)


def clashing(df):
    """Extra columns named like those that operators use inside or give back."""
    from pyspark.sql import functions as F

    names = "row best size kept keep_id digest n gram a b id component grp token_ids n_tokens decoded score".split()
    return df.withColumns({name: F.lit("clash") for name in names})
