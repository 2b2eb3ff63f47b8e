"""Similarity of names on a scale of 0 to 100: whole numbers throughout, division cuts off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from namelode.functions import names as nm
from namelode.functions.lexicon import COMMON_TOKENS
from namelode.functions.names import let

# Floors, weights and limits of the rules.
TOKEN_FLOOR, TOKEN_ACCEPT, SKELETON_SCORE, SKELETON_LETTERS = 65, 85, 85, 3
GIVEN_FLOOR, FAMILY_FLOOR, GIVEN_SHORTFALL, FAMILY_SHORTFALL = 72, 80, 60, 55
CHAIN_FLOOR, SWAP_FACTOR = 72, 72
MASS_FLOOR, WEAK_CEILING, CLEAN_CHAIN = 150, 74, 95
WEIGHT_BANDS = ((500, 20), (200, 35), (50, 55), (10, 80))  # share of records in 1/10,000: weight
RARE_WEIGHT, COMMON_WEIGHT = 100, 20
FALLBACK = tuple(dict.fromkeys(w[2:] if len(w) >= 5 and w[:2] in ("ال", "al", "el") else w for w in nm.normal_set(COMMON_TOKENS)))


def div(a: Column, b: Column | int) -> Column:
    """Whole division that cuts off."""
    return F.call_function("div", a.cast("bigint"), (F.lit(b) if isinstance(b, int) else b).cast("bigint"))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """How much of the longer text needs no edit, in percent; 100 if both are ''."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(100).cast("bigint")).otherwise(div((longer - F.levenshtein(a, b)) * 100, longer))


def prepared(tokens: Column) -> Column:
    """Words with what their comparison needs, computed once for each: (t, bare, bones)."""
    def one(t: Column) -> Column:
        return let(nm.strip_article(t), lambda bare: F.struct(t.alias("t"), bare.alias("bare"), nm.skeleton(bare).alias("bones")))

    return F.transform(tokens, one)


def prepared_similarity(a: Column, b: Column) -> Column:
    """``token_similarity`` of two prepared words."""
    longer = F.greatest(F.length(a["bare"]), F.length(b["bare"]))
    budget = F.when(longer <= 2, 0).when(longer <= 7, 1).when(longer <= 11, 2).otherwise(3)

    def judged(d: Column) -> Column:
        share = div((longer - d) * 100, longer)
        return (
            F.when((d <= budget) & (share >= TOKEN_ACCEPT), share)
            .when((F.length(a["bones"]) >= SKELETON_LETTERS) & (a["bones"] == b["bones"]), F.greatest(share, F.lit(SKELETON_SCORE).cast("bigint")))
            .when((d > budget) | (share < TOKEN_FLOOR), F.lit(0).cast("bigint"))
            .otherwise(share)
        )

    return F.when((a["t"] == b["t"]) | (a["bare"] == b["bare"]), F.lit(100).cast("bigint")).otherwise(
        let(F.levenshtein(a["bare"], b["bare"]), judged)
    )


def token_similarity(a: Column, b: Column) -> Column:
    """Similarity of two normalised words: edits within a budget by length, or equal consonants."""
    one = lambda c: prepared(F.array(c))[0]
    return let(F.struct(one(a).alias("a"), one(b).alias("b")), lambda p: prepared_similarity(p["a"], p["b"]))


def _best(token: Column, tokens: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(tokens, lambda t: prepared_similarity(token, t))), F.lit(0).cast("bigint"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def average_best(source: Column, target: Column) -> Column:
    """The mean similarity of each word of ``source`` with its best counterpart; 0 without words."""
    return F.when(F.size(source) == 0, F.lit(0).cast("bigint")).otherwise(
        div(_total(F.transform(source, lambda s: _best(s, target))), F.size(source))
    )


def _ratio(q: Column, c: Column) -> Column:
    return div(F.least(F.size(q), F.size(c)) * 100, F.greatest(F.size(q), F.size(c)))


def subset_boosted(base: Column, forward: Column, nq: Column, nc: Column) -> Column:
    """The score raised where a query is well covered by a longer name."""
    coverage = div(nq * 100, nc)
    most = base + F.when(nq >= 4, 18).otherwise(12)
    raised = F.greatest(base, F.least(forward - div(100 - coverage, 2), most))
    return F.when((nq >= 2) & (nq < nc) & (forward >= 90) & (coverage >= 40), raised).otherwise(base)


def part_gated(score: Column, query: Column, candidate: Column) -> Column:
    """The score cut where the first or last word of a query has no counterpart."""
    absent = lambda t, floor: (F.length(t["t"]) >= 3) & ~F.exists(candidate, lambda c: prepared_similarity(t, c) >= floor)
    two = F.size(query) >= 2
    score = F.when(two & absent(F.get(query, F.lit(0)), GIVEN_FLOOR), div(score * GIVEN_SHORTFALL, 100)).otherwise(score)
    return F.when(two & absent(F.get(query, F.size(query) - 1), FAMILY_FLOOR), div(score * FAMILY_SHORTFALL, 100)).otherwise(score)


def name_form(name: Column, entity: bool = False) -> Column:
    """Everything a scorer needs of a name, to be computed once for each name and stored beside it."""
    def person(n: Column, tokens: Column, shorter: Column) -> Column:
        return F.struct(n.alias("n"), prepared(tokens).alias("all"), prepared(shorter).alias("short"),
                        prepared(nm.without_connectors(shorter)).alias("kept"), prepared(nm.content_tokens(tokens)).alias("content"))

    def organisation(n: Column, tokens: Column, sig: Column) -> Column:
        none = F.size(sig) == 0
        noise = F.when(none, F.array().cast("array<string>")).otherwise(F.filter(tokens, lambda t: t.isin(*nm.ENTITY_NOISE)))
        return F.struct(n.alias("n"), prepared(F.when(none, tokens).otherwise(sig)).alias("sig"), prepared(noise).alias("noise"))

    def form(n: Column) -> Column:
        if entity:
            return let(nm.tokenize(n), lambda t: let(F.filter(t, lambda w: ~w.isin(*nm.ENTITY_NOISE)), lambda sig: organisation(n, t, sig)))
        return let(nm.tokenize(n), lambda t: let(nm.short_filtered(t), lambda shorter: person(n, t, shorter)))

    return let(nm.normalize(name), form)


def _guarded(q: Column, c: Column, score: Column) -> Column:
    return (
        F.when((F.coalesce(q["n"], F.lit("")) == "") | (F.coalesce(c["n"], F.lit("")) == ""), F.lit(0).cast("bigint"))
        .when(q["n"] == c["n"], F.lit(100).cast("bigint"))
        .otherwise(score)
    )


def score_name_forms(q: Column, c: Column) -> Column:
    """``score_name`` of two name forms."""
    bare = (F.size(q["short"]) == 0) | (F.size(c["short"]) == 0)
    qt, ct = F.when(bare, q["all"]).otherwise(q["kept"]), F.when(bare, c["all"]).otherwise(c["kept"])

    def blended(p: Column) -> Column:
        qs, cs = p["q"], p["c"]

        def total(s: Column) -> Column:
            base = div(F.least(s["f"], s["r"]) * 70 + s["full"] * 20 + _ratio(qs, cs) * 10, 100)
            return let(subset_boosted(base, s["f"], F.size(qs), F.size(cs)), lambda b: F.least(part_gated(b, qs, cs), F.lit(100).cast("bigint")))

        return let(F.struct(average_best(qs, cs).alias("f"), average_best(cs, qs).alias("r"),
                            levenshtein_similarity(q["n"], c["n"]).alias("full")), total)

    return _guarded(q, c, let(F.struct(qt.alias("q"), ct.alias("c")), blended))


def score_entity_forms(q: Column, c: Column) -> Column:
    """``score_entity`` of two entity name forms."""
    core = F.least(average_best(q["sig"], c["sig"]), average_best(c["sig"], q["sig"]))
    total = div(core * 65 + levenshtein_similarity(q["n"], c["n"]) * 20 + _ratio(q["sig"], c["sig"]) * 15, 100)
    bonus = F.when((F.size(q["noise"]) > 0) & (F.size(c["noise"]) > 0), div(average_best(q["noise"], c["noise"]), 10)).otherwise(0)
    return _guarded(q, c, F.least(total + bonus, F.lit(100).cast("bigint")))


def score_name(query: Column, candidate: Column) -> Column:
    """Similarity of two personal names."""
    pair = F.struct(name_form(query).alias("q"), name_form(candidate).alias("c"))
    return let(pair, lambda p: score_name_forms(p["q"], p["c"]))


def score_entity(query: Column, candidate: Column) -> Column:
    """Similarity of two organisations' names."""
    pair = F.struct(name_form(query, True).alias("q"), name_form(candidate, True).alias("c"))
    return let(pair, lambda p: score_entity_forms(p["q"], p["c"]))


def token_weight(bare: Column, df: Column | None = None, documents: Column | None = None) -> Column:
    """The weight of a word without its article by the share of records that hold it.

    Without measured frequencies (``documents`` null or 0) common names of a fixed list weigh least.
    """
    fallback = F.when(bare.isin(*FALLBACK), COMMON_WEIGHT).otherwise(RARE_WEIGHT)
    if df is None or documents is None:
        return fallback.cast("bigint")
    held = F.coalesce(df, F.lit(0)) * 10_000
    banded = F.lit(None)
    for share, weight in reversed(WEIGHT_BANDS):
        banded = F.when(held >= documents * share, weight).otherwise(RARE_WEIGHT if share == WEIGHT_BANDS[-1][0] else banded)
    return F.when(F.coalesce(documents, F.lit(0)) > 0, banded).otherwise(fallback).cast("bigint")


def order_alignment(q: Column, c: Column) -> Column:
    """The share of the longer name whose words pair up in the same order."""
    start = F.array().cast("array<int>")

    def pair(taken: Column, token: Column) -> Column:
        sims = F.transform(c, lambda t, j: F.struct(prepared_similarity(token, t).alias("s"), (-j).alias("j")))
        free = F.filter(sims, lambda s: ~F.array_contains(taken, -s["j"]))
        return let(F.array_max(free), lambda best: F.when(best["s"] >= CHAIN_FLOOR, F.array_append(taken, -best["j"])).otherwise(taken))

    def longer_run(runs: Column, p: Column) -> Column:
        before = F.filter(runs, lambda r: r["p"] < p)
        n = F.coalesce(F.array_max(F.transform(before, lambda r: r["n"])), F.lit(0)) + 1
        return F.array_append(runs, F.struct(p.alias("p"), n.alias("n")))

    places = F.aggregate(q, start, pair)
    runs = F.aggregate(places, F.array().cast("array<struct<p:int,n:int>>"), longer_run)
    longest = F.coalesce(F.array_max(F.transform(runs, lambda r: r["n"])), F.lit(0))
    return div(longest * 100, F.greatest(F.size(q), F.size(c)))


def chain_alignment(q: Column, c: Column) -> Column:
    """How well two names line up as chains of given, father's and family name."""
    at = lambda x, i: F.get(x, F.lit(i)) if isinstance(i, int) else F.get(x, i)
    parts = F.struct(
        prepared_similarity(at(q, 0), at(c, 0)).alias("head"),
        prepared_similarity(at(q, F.size(q) - 1), at(c, F.size(c) - 1)).alias("family"),
        order_alignment(q, c).alias("order"),
    )
    long = (F.size(q) >= 3) & (F.size(c) >= 3)
    return let(parts, lambda p: F.when(
        long, div(p["head"] * 35 + prepared_similarity(at(q, 1), at(c, 1)) * 20 + p["family"] * 30 + p["order"] * 15, 100)
    ).otherwise(div(p["head"] * 45 + p["family"] * 35 + p["order"] * 20, 100)))


def generational_swap(q: Column, c: Column) -> Column:
    """Whether each given name stands deeper in the other chain, as with father and son."""
    tail = lambda x: F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))
    deeper = lambda t, x: F.exists(tail(x), lambda o: prepared_similarity(t, o) >= CHAIN_FLOOR)
    q0, c0 = F.get(q, F.lit(0)), F.get(c, F.lit(0))
    return (F.size(q) >= 3) & (F.size(c) >= 3) & (prepared_similarity(q0, c0) < CHAIN_FLOOR) & deeper(q0, c) & deeper(c0, q)


def score_name_v2_forms(q: Column, c: Column, weight=None) -> Column:
    """``score_name_v2`` of two name forms; ``weight`` gives a word's weight (default: the fixed list)."""
    weigh = weight or (lambda bare: token_weight(bare))

    def weighted(source: Column, target: Column) -> Column:
        rows = F.transform(source, lambda s: F.struct(weigh(s["bare"]).alias("w"), _best(s, target).alias("b")))
        return let(rows, lambda r: F.struct(
            F.coalesce(div(_total(F.transform(r, lambda x: x["w"] * x["b"])), _total(F.transform(r, lambda x: x["w"]))), F.lit(0)).alias("score"),
            _total(F.transform(r, lambda x: F.when(x["b"] >= CHAIN_FLOOR, x["w"]).otherwise(0))).alias("mass"),
        ))

    def total(p: Column) -> Column:
        qs, cs = q["content"], c["content"]
        base = div(F.least(p["f"]["score"], p["r"]["score"]) * 60 + p["chain"] * 25 + p["full"] * 15, 100)
        boosted = subset_boosted(base, p["f"]["score"], F.size(qs), F.size(cs))
        swapped = let(boosted, lambda b: F.when(generational_swap(qs, cs), div(b * SWAP_FACTOR, 100)).otherwise(b))
        held = let(swapped, lambda s: F.when(
            (p["f"]["mass"] >= MASS_FLOOR) | (p["chain"] >= CLEAN_CHAIN), s
        ).otherwise(F.least(s, F.lit(WEAK_CEILING).cast("bigint"))))
        return F.greatest(F.lit(0).cast("bigint"), F.least(held, F.lit(100).cast("bigint")))

    parts = F.struct(weighted(q["content"], c["content"]).alias("f"), weighted(c["content"], q["content"]).alias("r"),
                     chain_alignment(q["content"], c["content"]).alias("chain"), levenshtein_similarity(q["n"], c["n"]).alias("full"))
    return _guarded(q, c, let(parts, total))


def score_name_v2(query: Column, candidate: Column) -> Column:
    """The second scorer: words by weight, and their order as a chain."""
    pair = F.struct(name_form(query).alias("q"), name_form(candidate).alias("c"))
    return let(pair, lambda p: score_name_v2_forms(p["q"], p["c"]))


def adjusted_score(name_score: Column, adjustment: Column, min_score: int, policy: str = "downweight") -> Column:
    """The name score with the adjustment, within 0..100; downweighting keeps strong names at ``min_score``."""
    total = F.greatest(F.lit(0).cast("bigint"), F.least(name_score + adjustment, F.lit(100).cast("bigint")))
    if policy == "filter":
        return total
    return F.when((adjustment < 0) & (name_score >= 90) & (total < min_score), F.lit(min_score).cast("bigint")).otherwise(total)
