"""Removal of repeated passages as a stage: rows of one id, rows without one, other columns, short runs."""

import random

from lorebase.llm import suffixes

COLUMNS = "doc_id long, text string, id string, mark long, runs int"


def test_rows_stay_rows(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    passage, short = " ".join(words[:60]), " ".join(words[100:145])
    own = [" ".join(rng.sample(words[200:], 30)) for _ in range(6)]
    rows = [(1, f"{own[0]} {passage}", "a"), (1, f"{passage} {own[1]}", "b"), (None, f"{own[2]} {short}", "c"), (None, f"{short} {own[3]}", "d"), (None, None, "e"), (5, "", "f"), (6, own[4], "g"), (6, own[4], "h")]
    df = spark.createDataFrame([(i, t, x, 1, 2) for i, t, x in rows], COLUMNS)
    got = {r.id: r for r in suffixes.without_repeats(df, length=200, least_words=50).collect()}
    assert len(got) == 8 and all((got[x].doc_id, got[x].mark, got[x].runs) == (i, 1, 2) for i, _, x in rows)
    assert got["a"].text.split() == own[0].split() and got["b"].text.split() == own[1].split()
    assert all(got[x].text == t for _, t, x in rows[2:])  # 45 words and 30 words stay
    bare = {r.id: r.text for r in suffixes.without_repeats(df, length=160).collect()}
    assert bare["c"].split() == own[2].split() and bare["g"] == bare["h"] == ""
    assert suffixes.without_repeats(df.limit(0)).count() == 0
