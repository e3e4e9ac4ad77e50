"""Documents with what breaks text operators: nulls, empty and long texts, copies, ties, odd white space, bytes of all kinds."""

from __future__ import annotations

import random


def documents() -> list[tuple]:
    r = random.Random(3)
    words = ["the", "of", "and", "straße", "naïve", "漢字", "x1", "foo-bar", "A.B", "don't", "we'll", "🙂", "Ünïcode", "tail,"]
    make = lambda n: " ".join(r.choice(words) + r.choice(["", "", "s", str(r.randrange(9))]) for _ in range(n))
    passage = make(60)
    long = make(9000)
    base = [make(r.randrange(1, 200)) for _ in range(60)]
    texts = [
        *base,
        None,
        "",
        " ",
        "\n\t \x0b\x0c\r\n",
        "a",
        "a" * 3000,
        "ab " * 700,
        "x y z " * 50,
        long,
        long[:20000] + " changed " + long[20000:],
        passage,
        make(30) + " " + passage + " " + make(30),
        make(5) + "\n" + passage.upper() + "\n" + passage,
        base[3],
        base[3],
        base[4] + " one",
        "é" * 60 + "  double  spaces   nbsp em \x85 nel \x1c fs\x00nul",
        "e-mail a@b.c_d@e.f, ip 1.2.3.4.5.6.7.8 and 300.1.1.1, card 4111 1111-1111 1111, tel +1 (2) 3-4567-89",
        "line one\nline two\nline one\n\nline one\n" * 3,
        "12 345\n\n\n   trailing   ",
        "<|endoftext|> special 'S 's",
    ]
    rows = [(i * 3 % 101 + (200 if i > 70 else 0), t, r.choice(["en", "de", None]), r.choice(["s0", "s0", "s1", None])) for i, t in enumerate(texts)]
    rows += [rows[0], rows[10]]  # repeated rows
    rows.append((rows[5][0], "another text of the same id " + passage, "en", "s0"))
    rows.append((None, base[6], "en", "s0"))
    return [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None):
    """The documents with further columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
    for name in ("ids", "fp", "block", "first", "digest", "id", "start", "kept"):
        df = df.withColumn(name, F.lit("clash"))
    return df
