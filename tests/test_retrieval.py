import random
import re

from namelode.operators import retrieval

KINDS = "id long, record_id long, " + ", ".join(f"{c} string" for c in retrieval.NAME_COLUMNS)


def _names(spark, rows):
    return spark.createDataFrame([(i, i + 1000, *(r + (None,) * 6)[:6]) for i, r in enumerate(rows)], KINDS)


def _rows(df):
    return sorted((r["query_id"], r["name_id"], r["record_id"]) for r in df.collect())


def test_like_rows_keeps_every_match(spark):
    names = _names(spark, [("Ann", None, f"Lee{i}") for i in range(700)])
    asked = spark.createDataFrame([(1, "ann lee"), (2, "ann l_e")], "query_id long, name string")
    assert _rows(retrieval.like_rows(asked, names)) == [(q, i, i + 1000) for q in (1, 2) for i in range(700)]


def test_like_rows_same_as_brute_force(spark):
    pick = random.Random(5)
    word = lambda: "".join(pick.choice("abAé") for _ in range(pick.choice((1, 2, 2, 3, 4, 7, 8))))
    text = lambda: pick.choice((" ", "\u00a0", "  ")).join(word() for _ in range(pick.choice((1, 1, 2, 3))))
    rows = [tuple(pick.choice((None, "", text())) for _ in range(6)) for _ in range(300)]
    searched = [" ".join(word() for _ in range(n)) for n in (1, 2, 2, 3, 3, 4, 5, 6) * 5] + ["ab ab", "ab ab ba", "a_b ba", "%b", "__", "", "a"]
    want = []
    for q, name in enumerate(searched):
        tokens = [t.lower() for t in name.split() if len(t) >= 2]
        like = [re.compile(".*".join(".".join(map(re.escape, p.split("_"))) for p in t.split("%")), re.S) for t in tokens]
        least = len(tokens) if len(tokens) <= 2 else (len(tokens) + 1) // 2
        for i, r in enumerate(rows):
            if tokens and sum(any(c is not None and t.search(c.lower()) for c in r) for t in like) >= least:
                want.append((q, i, i + 1000))
    asked = spark.createDataFrame(list(enumerate(searched)), "query_id long, name string")
    assert len(want) > 500 and _rows(retrieval.like_rows(asked, _names(spark, rows))) == want


def test_like_rows_meet_by_words(spark):
    asked = spark.createDataFrame([(1, "ann lee")], "query_id long, name string")
    found = retrieval.like_rows(asked, _names(spark, [("Ann", None, "Lee")]))
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and _rows(found) == [(1, 0, 1000)]
