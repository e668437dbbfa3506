from __future__ import annotations

import random

import pytest

WORDS = ["the", "of", "there", "Thing", "été", "über", "ingly", "ation", "x", "日本", "cat's", "42", "edly.", "or,", "No!"]


@pytest.fixture(scope="session")
def documents(spark):
    """Small documents with every odd case, and their rows."""
    r = random.Random(3)
    say = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 60)) for _ in range(n))
    base = [say(r.randint(25, 90)) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    near = base[0].split(" ")
    near[3] = "other"
    rows += [
        (100, base[0], "en", "s0", 0), (101, base[0].upper(), "en", "s0", 0), (102, " ".join(near), "en", "s1", 0), (102, " ".join(near), "en", "s1", 0), (103, None, None, None, None),
        (104, "", "en", "s0", 0), (105, " \n\t ", "en", "s0", 3), (106, "one two", "en", "s0", 7), (107, "one  TWO", "en", "s0", 8), (None, base[1], "en", "s0", 0), (108, "x" * 2_000, "en", "s0", 1),
        (109, say(6000), "en", "s0", 1), (110, "a b c d e f g h " * 40, "en", "s0", 1), (111, "word%%% " * 60, "en", "s0", 1), (112, "mail me at jo.doe@mail.example.com or +1 (988) 555-2485 now " + say(20), "en", "s0", 1),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), rows
