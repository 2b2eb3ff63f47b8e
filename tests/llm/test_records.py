"""Words, copies, canonical values and identities by cases and against brute force."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from namelode.llm import canonical_list, distinctive, entity_match, formatting, identity, name_variants
from namelode.llm.distance import banded_distance

NAMES = ("id bigint, record_id bigint, name_type string, title_honorific string, first_name string, middle_name string, surname string, maiden_name string, suffix string, "
         "single_string_name string, original_script_name string, entity_name string")  # fmt: skip
RECORDS = "id bigint, record_type string, gender string, custom_list_id bigint, word string"
DATES = "id bigint, record_id bigint, date_type string, day string, month string, year string, note string"
LANDS = "id bigint, record_id bigint, country_type string, country_code string, country_name string"


def name(i, record, first, middle, last, kind="Primary Name", entity=None):
    return (i, record, kind, None, first, middle, last, None, None, None, None, entity)


def tables(spark, people, wide=False):
    """people: (id, list, first, middle, last, year, code)"""
    records = spark.createDataFrame([(p[0], "Person", None, p[1], "x") for p in people], RECORDS)
    names = spark.createDataFrame([name(i, p[0], *p[2:5]) for i, p in enumerate(people)], NAMES)
    dates = spark.createDataFrame([(i, p[0], "Date of Birth", None, None, p[5], None) for i, p in enumerate(people) if p[5]], DATES)
    lands = spark.createDataFrame([(i, p[0], "Nationality", p[6], None) for i, p in enumerate(people) if p[6]], LANDS)
    return records, names, dates, lands


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 7))) for _ in "ab")
        for most in range(4):
            assert banded_distance(a, b, most) == min(osa(a, b), most + 1)


def test_initials_and_other_scripts(spark):
    names = [(1, 1, "Primary Name", None, None, None, None, None, None, "L. F.", "\u063a\u064a\u0627\u0646\u062a\u0627\u0643 \u0643\u0627\u0631\u0643\u0645\u0628\u0648\u0631", None),
             (2, 2, "Primary Name", None, "J.", None, "Karkembur", None, None, None, None, None), (3, 3, None, None, None, None, None, None, None, None, "\u0425\u0435\u043d\u0442\u043e \u0417\u0443\u0442\u0435\u0437\u0435\u043b", "")]
    got = {r["id"]: r["bag"] for r in identity.name_bags(spark.createDataFrame(names, NAMES)).filter("script or id = 2").collect()}
    assert got == {1: ["giantak", "karkmbur"], 2: ["j", "karkembur"], 3: ["khento", "zutezel"]}
    assert identity.word_likeness("j", "jurva") == 0.6 and identity.word_likeness("khento", "hento") == 0.8


PEOPLE = [(1, None, "Giantak", "Loskaibad", "Khukem", "1970", "AA"), (2, None, "Gianchik", "Loskaibad", "Khukem", None, "AA"), (3, None, "Khukeem", None, "Giantak", "1970", "AA"),
          (4, None, "Giantak", "Vambai", "Khukem", "1970", "BB"), (5, None, "Zezash", "Loskaibad", "Khukem", "1950", "AA"), (6, None, "Marta", None, "Stumbolik", "1981", "CC"),
          (7, None, "Marta", None, "Stmubolik", "1981", "CC"), (8, None, None, None, None, "1981", "CC"), (9, 7, "Giantak", "Loskaibad", "Khukem", "1970", "Aaland"), (10, 7, "Martha", "", "STUMBOLIK", "12.3.1981", None)]


def test_same_names(spark):
    records, names, dates, lands = tables(spark, PEOPLE)
    people = identity.profiles(records.filter("custom_list_id is null"), names.withColumn("gender", F.lit("clash")), dates, identity.listed_codes(lands))
    got = {tuple(r) for r in name_variants.same_name_records(people).collect()}
    assert {(1, 2), (6, 7)} <= got and not {(1, 4), (1, 5), (2, 5), (2, 4)} & got and all(8 not in p for p in got)
    assert name_variants.same_name_records(people.limit(0)).count() == 0


def test_matches_across_sources(spark):
    records, names, dates, lands = tables(spark, PEOPLE)
    reference = spark.createDataFrame([("AA", "Aaland"), ("BB", "Beland"), ("CC", "Celand")], "code string, name string")
    people = identity.profiles(records, names, dates, entity_match.mapped_codes(lands, reference))
    rows = entity_match.matched_records(people).collect()
    got = {(r["record_id_a"], r["record_id_b"]) for r in rows}
    assert {(1, 9), (6, 10)} <= got and not {(4, 9), (5, 9)} & got and all(0 < r["confidence"] <= 1 for r in rows)
    assert entity_match.matched_records(people.limit(0)).count() == 0


def test_vectors_tell_words_apart():
    vectors = entity_match.Vectors({}, np.zeros((0, entity_match.DIMENSIONS), np.float32))
    near, far = vectors.row(["stumbolik"]) @ vectors.row(["stumbolig"]), vectors.row(["stumbolik"]) @ vectors.row(["giantak"])
    assert near > 0.5 > far


def test_copies(spark):
    people = [(1, None, "Ann-Mary", None, "LEE", "1970", "A A"), (2, None, " lee ", "ann", "Mary", "1 9-70", "aa"), (3, None, "Ann", "Mary", "Lee", "1971", "AA"), (4, None, "Ann", "Mary", "Lee", None, "AA"),
              (5, None, "Ann", None, None, "1970", "AA")] + [(100 + i, None, "Hot", None, "Name", None, None) for i in range(300)]
    records, names, dates, lands = tables(spark, people)
    names = names.unionByName(names.withColumn("id", F.col("id") + 10_000))
    got = {tuple(r) for r in formatting.formatting_copies(records, names, dates, lands).collect()}
    assert got == {(1, 2)} | {(100, 100 + i) for i in range(1, 300)}
    sizes = {tuple(r) for r in formatting.collapsed_records(records, names, dates, lands).collect()}
    assert sizes == {(1, 2), (100, 300)}
    assert formatting.formatting_copies(records.limit(0), names, dates, lands).count() == 0


def brute_scores(words, lam, rounds):
    df = Counter(t for w in words.values() for t in w)
    total = sum(df.values())
    out = {}
    for r, w in words.items():
        mass = sum(w.values())
        p = {t: n / mass for t, n in w.items()}
        for _ in range(rounds):
            e = {t: w[t] * lam * p[t] / (lam * p[t] + (1 - lam) * df[t] / total) for t in w}
            p = {t: x / sum(e.values()) for t, x in e.items()}
        out |= {(r, t): x for t, x in p.items()}
    return out


@pytest.mark.parametrize("wide", [20_000, 3])
def test_distinctive_words(spark, monkeypatch, wide):
    monkeypatch.setattr(distinctive, "WIDE_RECORD", wide)
    rng = random.Random(3)
    pool = ["giantak"] * 6 + ["khukem", "vomel", "stupin", "raibe", "zandol", "dikam", "Éluard", "ab"]
    rows = [name(i, i % 15, " ".join(rng.choices(pool, k=rng.randint(0, 3))), None, rng.choice(pool + [None])) for i in range(60)] + [name(99, None, "giantak", None, "x")]
    names = spark.createDataFrame(rows, NAMES).withColumn("word", F.lit("clash")).withColumn("df", F.lit(1))
    rounds = 12 if wide > 100 else 3
    scored = {(r["record_id"], r["word"]): r for r in distinctive.score_words(names, rounds=rounds, settled=0.0).collect()}
    words = {}
    for r in rows:
        for t in (r[4] or "").lower().split() + (r[6] or "").lower().split():
            if len(t) >= 3 and r[1] is not None:
                words.setdefault(r[1], {}).setdefault(t, 0)
                words[r[1]][t] += 1
    want = brute_scores(words, 0.1, rounds)
    assert scored.keys() == want.keys() and all(math.isclose(scored[k]["score"], want[k], rel_tol=1e-6, abs_tol=1e-12) for k in want)
    pairs = {tuple(r) for r in distinctive.shared_rare_words(distinctive.score_words(names, lam=0.9), 5).collect()}
    holders = {}
    for r, w in words.items():
        for t in w:
            holders.setdefault(t, set()).add(r)
    assert pairs == {p for h in holders.values() if len(h) <= 5 for p in itertools.combinations(sorted(h), 2)}
    assert distinctive.score_words(names.limit(0)).count() == 0


def test_the_model_chooses_rare_words(spark):
    """Common words lose their mass where a record has rarer ones; without rounds none does. Every word of three holders stays."""
    rng = random.Random(4)
    rare = [f"rare{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(100)]
    names = spark.createDataFrame([name(i, i, "giantak", None, f"{rng.choice(rare)} khukem") for i in range(250)], NAMES)
    kept = {n: distinctive.score_words(names, rounds=n).filter(F.col("specific") >= distinctive.SPECIFIC) for n in (0, distinctive.ROUNDS)}
    common = {n: rows.filter("word in ('giantak', 'khukem')").count() for n, rows in kept.items()}
    assert common == {0: 500, distinctive.ROUNDS: 0}
    assert kept[distinctive.ROUNDS].filter("df <= 3").count() == kept[0].filter("df <= 3").count() > 0


def test_set_similarity_join_loses_nothing(spark):
    rng = random.Random(5)
    left, right = (sorted({"".join(rng.choices("abcd", k=rng.randint(1, 6))) for _ in range(60)}) for _ in "lr")
    sets = lambda w: {f"^{w}$"[i : i + 2] for i in range(len(w) + 1)}
    got = {(r["l"], r["r"]) for r in canonical_list.similar_sets(spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string"), 0.4).collect()}
    assert got == {(a, b) for a in left for b in right if len(sets(a) & sets(b)) / len(sets(a) | sets(b)) >= 0.4 - 1e-9}


def test_mapped_countries(spark):
    reference = spark.createDataFrame([("NOVINE", "North Vinesh"), ("SOVINE", "South Vinesh"), ("TULOV", "Kingdom of Tulovia"), ("FITOV", "Kingdom of Fitova"), ("KELVE", "Kingdom of Kelveru"), (None, "Nowhere"), ("GIZHAN", None)], "code string, name string")
    cases = {"NOVINE": None, "novine": "NOVINE", "Vinesh (South)": "SOVINE", "N. Vinesh": "NOVINE", "tulvoia": "TULOV", "Tulovian national": "TULOV", "Some Port, Fitova": "FITOV", "Klvr": "KELVE", "KEL-VE": "KELVE",
             "Vinesh": "", "Duchy of Braindiafistan": "", "?": "", "": "", None: "", "GIZHAM": "GIZHAN"}
    rows = [(i, 1, None, v, None) for i, v in enumerate(cases)] + [(50, 1, None, None, "Fitova"), (51, 1, None, "see notes", "kelveru")] + [(1000 + i, 1, None, "novine", None) for i in range(3000)]
    frame = spark.createDataFrame(rows, LANDS).withColumn("code", F.lit("clash")).withColumn("typed", F.lit("clash"))
    got = {r["country_row_id"]: r["code"] for r in canonical_list.mapped_countries(frame, reference).collect()}
    assert {v: got.get(i) for i, v in enumerate(cases)} == cases
    assert got[50] == "FITOV" and got[51] == "KELVE" and len(got) == len(rows) - 1
    assert {r["code"] for r in canonical_list.mapped_countries(frame.limit(5), reference.limit(0)).collect()} == {""}
    assert canonical_list.mapped_countries(frame.limit(0), reference).count() == 0
