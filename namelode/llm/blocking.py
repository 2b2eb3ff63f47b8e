"""How records that share a block meet, however many share it, and what rules a pair out before it is compared."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namelode.llm.identity import JOINED

#: Blocks of so few indexed rows meet as they are, without looking at what the records say: changes no result, see ``met``.
FEW = 16
#: Indexed rows of a larger block that meet in one place.
TILE = 10_000
#: What ``facts`` says of a profile.
FACTS = ("kind", "years", "around", "codes")


def _digits(years: Column) -> Column:
    return F.transform(years, lambda y: F.array_join(F.array_sort(F.split(y.cast("string"), "")), ""))


def _around(years: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(years, lambda y: F.array(y - 1, y, y + 1))))


def _bits(values: Column) -> Column:
    """64 bits, those that ``values`` hash to set; none for no values."""
    bit = lambda v: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(v), F.lit(64)).cast("int"))
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda bits, v: bits.bitwiseOR(bit(v)))


def _signs(word: Column, indexed: bool) -> Column:
    """Hashes of which ``word`` has one in common with each word that ``identity.word_likeness`` finds like it, one of the two ``indexed``.

    Words of n letters within e edits keep n - e common ones in order, so their first three are among the first five of both
    where e is 2 and both have six or more, and among the first four where e is 1 and n is 4; so are the first three of a beginning or a stem. Half like
    words (e is 2, n 4 or 5) have the same first letter and one more of the next three. Initials and words of two letters are met by beginnings.
    """
    n, at = F.length(word), lambda i: F.substring(word, i, 1)
    three = [F.when(n >= (places[-1] if places[-1] < 5 else 6), F.hash(*map(at, places))) for places in combinations(range(1, 6), 3)]
    half = [F.when(n.between(4, 7), F.hash(F.lit("~"), at(1), at(i))) for i in (2, 3, 4)]
    begun, whole = (",", ".") if not indexed else (".", ",")
    one = [F.when(n > 0, F.hash(F.lit(begun), at(1))), F.when(n == 1, F.hash(F.lit(whole), word))]
    begun, whole = (":", ";") if not indexed else (";", ":")
    two = [F.when(n > 1, F.hash(F.lit(begun), F.substring(word, 1, 2))), F.when(n == 2, F.hash(F.lit(whole), word))]
    return F.array_compact(F.array(*three, *half, *one, *two))


def _parted(word: Column) -> Column:
    """``word`` and, if it begins with a joined particle, the same without."""
    joined = f"^({'|'.join(JOINED)})(?=..)"
    return F.array_compact(F.array(word, F.when(word.rlike(joined), F.regexp_replace(word, joined, ""))))


def facts() -> list[Column]:
    """kind, years, around, codes of a profile, as numbers that ``facts_fit`` compares.

    ``kind`` has the letter of the gender (0 for none), whether it is an organisation and whether its name is long; the others
    are bits of the years' digits, of those of the years and their neighbours, and of the countries.
    """
    kind = F.coalesce(F.ascii("gender"), F.lit(0)) * 4 + F.when(F.col("entity"), 2).otherwise(0) + F.when(F.size("main") > 2, 1).otherwise(0)
    around = _bits(_digits(_around(F.col("years"))))
    return [kind.cast("int").alias("kind"), _bits(_digits(F.col("years"))).alias("years"), around.alias("around"), _bits(F.col("codes")).alias("codes")]


def facts_fit(a: str, b: str) -> Column:
    """False only where facts alone make ``identity.agreement`` reject two profiles; ``a`` and ``b`` stand before the names of their ``facts``.

    These are pairs of another kind, those whose years and countries both contradict each other, or one of them while
    the other is unknown and a name has but two words, and those of another gender and no common year. Years fit in both directions, or not at all. Kinds are compared null-safe,
    since a filter for missing ones below one of two equal exchanges would keep it from being used for both.
    """
    of = lambda side, c: F.col(f"{side}{c}")
    year = (of(a, "around").bitwiseAND(of(b, "years")) != 0) & (of(b, "around").bitwiseAND(of(a, "years")) != 0)
    land = of(a, "codes").bitwiseAND(of(b, "codes")) != 0
    no_year = ~year & (of(a, "years") != 0) & (of(b, "years") != 0)
    no_land = ~land & (of(a, "codes") != 0) & (of(b, "codes") != 0)
    other, long = of(a, "kind").bitwiseXOR(of(b, "kind")), of(a, "kind").bitwiseAND(of(b, "kind")).bitwiseAND(F.lit(1)) == 1
    fit = ~(no_year & no_land) & (year | land | ~(no_year | no_land) | long)
    return other.bitwiseAND(F.lit(2)).eqNullSafe(0) & fit & ((other < 4) | (of(a, "kind") < 4) | (of(b, "kind") < 4) | year)


def _words() -> list[Column]:
    """What of a profile ``_words_fit`` reads."""
    signs = lambda word, indexed: F.flatten(F.transform(_parted(word), lambda w: _signs(w, indexed)))
    return [
        F.size("main").alias("size"),
        F.transform("main", lambda w: signs(w, False)).alias("main"),
        F.array_distinct(F.flatten(F.transform("words", lambda w: signs(w, True)))).alias("words"),
    ]


def evidence() -> Column:
    """What of a profile ``could_agree`` reads."""
    return F.struct(*facts(), *_words())


def _words_fit(a: str, b: str) -> Column:
    """False only where words alone make ``identity.agreement`` reject two profiles.

    Of the words of the fuller name of each, as many as the other name is shorter may be like no word of the other.
    """
    of = lambda side, c: F.col(f"{side}.{c}")
    known = lambda w, y: F.arrays_overlap(w, of(y, "words"))
    every = lambda x, y: F.forall(of(x, "main"), lambda w: known(w, y))
    some = lambda x, y: F.size(F.filter(of(x, "main"), lambda w: ~known(w, y))) <= of(x, "size") - of(y, "size")
    return F.when(of(a, "size") < of(b, "size"), every(a, b) & some(b, a)).when(of(a, "size") > of(b, "size"), every(b, a) & some(a, b)).otherwise(every(a, b) & every(b, a))


def could_agree(a: str, b: str) -> Column:
    """False only where ``identity.agreement`` rejects the profiles whose ``evidence`` is ``a`` and ``b``."""
    return facts_fit(f"{a}.", f"{b}.") & _words_fit(a, b)


def side(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (id, kind, years, around, codes, ...) as the side ``key`` of ``met``: its id is ``key``, the name of each of its facts begins with that."""
    return rows.withColumnsRenamed({"id": key, **{c: f"{key}_{c}" for c in FACTS}})


def met(index: DataFrame, probes: DataFrame, people: DataFrame, fits: Column, few: int = FEW) -> DataFrame:
    """(a, b): ids ``a`` of ``index`` (a, h, facts, ...) and ``b`` of ``probes`` (b, h, facts, ...), see ``side``, with the same ``h`` that ``fits``.

    All of them whose facts fit, but that blocks of more than ``few`` indexed rows also leave out pairs that ``identity.agreement`` would reject for their words (see
    ``_words_fit``); so what agrees in the end is the same whatever ``few`` is. Such a block is laid out in squares of ``TILE`` indexed rows, each of which meets on its own.
    The few large blocks are looked up in a hash table, so probes, of which there may be very many, are never sorted.
    """
    squares = F.ceil(F.col("n") / TILE).cast("int").alias("k")
    held = index.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > few).select("h", squares).hint("shuffle_hash")
    index, probes = index.join(held, "h", "left"), probes.join(held, "h", "left")
    usual = index.filter("k is null").drop("k").hint("shuffle_hash").join(probes.filter("k is null").drop("k"), "h").filter(fits & facts_fit("a_", "b_"))
    known = people.select("id", "main", "words")

    def spread(side: DataFrame, key: str) -> DataFrame:
        rows = side.filter("k is not null").withColumn("own", F.pmod(F.xxhash64(F.lit(key), key), F.col("k")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        rows = rows.withColumn("g", F.xxhash64("h", *(("own", "other") if key == "a" else ("other", "own")))).drop("h", "k", "own", "other")
        rows = rows.join(known.withColumnRenamed("id", key), key).repartition("g")
        return rows.withColumn(f"p{key}", F.struct(*_words())).drop(*known.columns[1:])

    crowded = spread(index, "a").join(spread(probes, "b"), "g").filter(fits & facts_fit("a_", "b_") & _words_fit("pa", "pb"))
    return usual.select("a", "b").unionByName(crowded.select("a", "b")).distinct()


def profiled(pairs: DataFrame, people: DataFrame) -> DataFrame:
    """(a, b, pa, pb): ``pairs`` (a, b) of ids with the profiles of both."""
    side = people.select("id", F.struct(*(c for c in people.columns if c not in ("id", "official", "bags"))).alias("p"))
    left = pairs.join(side.select(F.col("id").alias("a"), F.col("p").alias("pa")), "a")
    return left.join(side.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b").select("a", "b", "pa", "pb")


def possible(pairs: DataFrame, people: DataFrame) -> DataFrame:
    """``profiled`` ``pairs``, without those that ``identity.agreement`` rejects for their facts alone, see ``facts_fit``."""
    slim = people.select("id", *facts())
    known = pairs.join(side(slim, "a"), "a").join(side(slim, "b"), "b")
    return profiled(known.filter(facts_fit("a_", "b_")).select("a", "b"), people)
