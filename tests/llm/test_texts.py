"""Tokenising, leakage, truncation and look-alike text against brute force and by cases."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from namelode.llm import leakage, lookalike, tokenize, truncated
from namelode.llm.queries import vocabulary_path

TEXTS = ["", "Hello world's  \n\n end ", "l'été — 東京 🎉🎉", "a" * 3000, "  \t ", "<|endoftext|>", "x1y22z333 don't WE'LL", "نص عربي", "é"]


@pytest.fixture(scope="module")
def machine():
    with open(vocabulary_path(), "rb") as file:
        return tokenize.Transducer(tokenize.read_ranks(file.read()), max_states=2000, max_words=500)


def test_ids_equal_the_library(machine):
    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    rng = random.Random(2)
    odd = ["".join(rng.choice("abcde \n\t'sé字🎉م019_-") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for text in TEXTS + odd:
        ids = machine.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids
        decoder = tokenize.StreamDecoder(machine.bytes_of)
        assert "".join(decoder.feed([i]) for i in ids) + decoder.end() == text


def test_encode_corpus(spark):
    rows = [(i, t, "other") for i, t in enumerate([*TEXTS, None, TEXTS[1]])] + [(None, "x", "other")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = tokenize.encode_corpus(docs, vocabulary_path())
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert len(got) == len(rows) and got[0] == [] and got[len(TEXTS)] == [] and got[1] == got[len(TEXTS) + 1]
    back = {r["doc_id"]: r["text"] for r in tokenize.decode_corpus(out, vocabulary_path()).collect()}
    assert all(back[i] == (t or "") for i, t, _ in rows)
    assert tokenize.encode_corpus(docs.limit(0), vocabulary_path()).count() == 0


def test_fm_index_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        text = np.concatenate([rng.integers(1, 5, rng.integers(1, 200)), [0]])
        index = leakage.FMIndex(text, 5)
        patterns = rng.integers(1, 5, (20, 3))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(len(text) - 2) if (text[i : i + 3] == p).all()]
            got = sorted(index.locate(np.arange(a, b))) if a < b else []
            assert got == want


def test_leaks(spark):
    words = [f"w{i}" for i in range(40)]
    item = " ".join(words)
    docs = [(1, "zz " + ", ".join(words[3:15]).upper() + "! zz"), (2, " ".join(words[3:14])), (3, None), (4, ""), (5, item), (5, item), (6, " ".join(words[:12] + ["zz"] + words[20:39])),
            (7, ("pad " * 20000) + "\n".join(words[5:20]))]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item_id", "2 as span_start")
    items = spark.createDataFrame([(10, item), (11, None), (12, "too short"), (13, item)], "item_id bigint, text string")
    got = {tuple(r) for r in leakage.leaked_items(frame, items).collect()}
    assert got == {(d, i) for d in (1, 5, 6, 7) for i in (10, 13)}
    spans = {(r["doc_id"], r["span_start"], r["span_end"]) for r in leakage.removal_spans(frame, items).collect()}
    assert (1, 3, 3 + len(", ".join(words[3:15]))) in spans and (5, 0, len(item)) in spans and len([s for s in spans if s[0] == 6]) == 2
    assert leakage.leaked_items(frame.limit(0), items).count() == 0 and leakage.leaked_items(frame, items.limit(0)).count() == 0
    assert {tuple(r) for r in leakage.unsearchable_items(items).collect()} == {(11, 0), (12, 2)}
    blocks = leakage.leaked_spans(frame, items, item_block=1, shard_words=5).select("doc_id", "item_id").distinct()
    assert {tuple(r) for r in blocks.collect()} == got


def test_truncation(spark):
    whole = "The clerk signed the paper at noon. Nobody else was there."
    rows = [(i, "limited", (f"Entry {i} says that the courier moved nine crates to the port and left again " * 3)[:100]) for i in range(20)]
    rows += [(100, "free", whole), (101, "free", whole[:-9]), (102, "free", whole + " (more)"), (103, None, whole[:20] + "…"), (104, "free", None), (105, "free", " \n"),
             (106, "free", '{"a": "b.", "c": 1}'), (107, "free", '{"a": "It ends here.'), (108, "free", 'He only said "later..."'), (109, "limited", ("x" * 91) + " is end."),
             (110, "free", "من يدير الشركة؟"), (111, "free", whole + "\nRef. AB-12345")]
    rows += [(200 + i, "free", f"{whole}\nRef. CD-{i:05d}") for i in range(5)] + [(300, "free", whole + "\nRef. CD")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").selectExpr("*", "1 as ending", "2 as label")
    got = {r["doc_id"]: r["cut"] for r in truncated.truncated_texts(docs).collect()}
    assert {d for d, cut in got.items() if cut} == {*range(20), 101, 102, 103, 107, 300}
    assert 104 not in got and 105 not in got
    limits = {(r["source"], r["limit"]) for r in truncated.hidden_limits(truncated.endings(docs)).collect()}
    assert limits == {("limited", 100)}
    assert truncated.truncated_texts(docs.limit(0)).count() == 0
    share = {r["source"]: r["cut_texts"] for r in truncated.truncation_by_source(docs).collect()}
    assert share["limited"] == 20 and share[""] == 1


CASES = [("Rendοul", True, "rendoul"), ("Ｈｕｚ　T", True, "huz t"), ("K⁠hu", True, "khu"), ("a b", True, "a b"), ("ó", True, "ó"), ("ﬁn", True, "fin"),
         ("ﺎ", True, "ا"), ("GmbН", True, "gmbh"), ("Hегил", True, "негил"), ("é ñ ß", False, "é ñ ss"),
         ("Иван Petrov", False, "иван petrov"), ("plain  Name\t", False, "plain name"), ("محـمد", False, "محـمد"), ("الجوکورفید", True, "الجوكورفيد"), ("چاپیک", False, "چاپیک"), ("", False, ""), (None, False, None)]


def test_lookalikes(spark):
    for value, disguised, form in CASES:
        assert lookalike.is_disguised(value) == disguised and lookalike.one_form(value) == form, value
    rows = [(i, v, None, None, "x") for i, (v, _, _) in enumerate(CASES)]
    names = spark.createDataFrame(rows, "id bigint, single_string_name string, original_script_name string, entity_name string, value string")
    got = {r["name_id"]: (r["form"], r["disguised"]) for r in lookalike.name_forms(names).collect()}
    for i, (value, disguised, form) in enumerate(CASES):
        if value:
            assert got[i] == (form, disguised), value
    assert lookalike.name_forms(names.limit(0)).count() == 0
