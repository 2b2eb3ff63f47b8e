"""How distinctive each word of a record is: a parsimonious language model of the record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namelode.session import durable

#: A word: an unbroken run of three or more letters.
WORD = r"\p{L}{3,}"
#: Records with more distinct words than this are modelled by aggregation instead of in one row.
WIDE_RECORD = 20_000
#: Rounds stop when the shares of a record move by less than this in all, or after so many.
SETTLED, ROUNDS = 1e-5, 40
#: Least probability that a word of a record comes from the record's own model, not the background, for it to set the record apart.
SPECIFIC = 0.01


def record_words(names: DataFrame, fields: tuple[str, ...] = ("first_name", "surname")) -> DataFrame:
    """(record_id, word, tf): the words of all name rows of a record, in lower case, with their number.

    Null and empty fields hold no words; rows without a record are dropped. Repeated rows count as
    often as they occur in tf but never make a record count twice.
    """
    text = F.lower(F.concat_ws("\n", *fields))
    words = F.explode(F.regexp_extract_all(text, F.lit(WORD), 0)).alias("word")
    return (
        names.filter(F.col("record_id").isNotNull())
        .select("record_id", words)
        .groupBy("record_id", "word")
        .agg(F.count("*").alias("tf"))
    )


def _converged(terms: Column, lam: float, rounds: int, settled: float) -> Column:
    """The record's model over ``terms`` (tf, background), by expectation-maximisation until it has ``settled``."""
    mass = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t["tf"])
    start = F.transform(terms, lambda t: t["tf"] / mass)

    def step(p: Column) -> Column:
        expected = F.zip_with(
            terms, p, lambda t, x: t["tf"] * lam * x / (lam * x + (1.0 - lam) * t["background"])
        )
        boxed = F.transform(
            F.array(expected),
            lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)),
        )
        moved = lambda q: F.aggregate(F.zip_with(q, p, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, b: a + b)
        return F.element_at(F.transform(boxed, lambda q: F.struct(q.alias("p"), moved(q).alias("moved"))), 1)

    begun = F.struct(start.alias("p"), F.lit(2.0).alias("moved"))
    return F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(rounds + 1)), 1, rounds), begun, lambda now, _: F.when(now["moved"] < settled, now).otherwise(step(now["p"])))["p"]


def _converged_wide(words: DataFrame, lam: float, rounds: int, settled: float) -> DataFrame:
    """The same for records of very many words, each round being two aggregations over salted parts."""
    salted = F.pmod(F.xxhash64("word"), F.lit(64))

    def per_record(df: DataFrame, value: Column, name: str) -> DataFrame:
        parts = df.groupBy("record_id", salted.alias("part")).agg(F.sum(value).alias("s"))
        return parts.groupBy("record_id").agg(F.sum("s").alias(name))

    mass = per_record(words, F.col("tf"), "mass")
    now = words.join(mass, "record_id").withColumn("score", F.col("tf") / F.col("mass")).drop("mass")
    for _ in range(rounds):
        seen = lam * F.col("score")
        now = now.withColumn("e", F.col("tf") * seen / (seen + (1.0 - lam) * F.col("background")))
        sums = per_record(now, F.col("e"), "sum_e")
        # each round reads the one before twice: without cutting the lineage the plan would double
        now = now.join(sums, "record_id").withColumn("before", F.col("score")).withColumn("score", F.col("e") / F.col("sum_e"))
        now = durable(now.drop("e", "sum_e"))
        moved = per_record(now, F.abs(F.col("score") - F.col("before")), "moved").agg(F.max("moved")).first()[0]
        now = now.drop("before")
        if moved is None or moved < settled:
            break
    return now


def score_words(
    names: DataFrame,
    lam: float = 0.1,
    rounds: int = ROUNDS,
    settled: float = SETTLED,
    fields: tuple[str, ...] = ("first_name", "surname"),
    one_in: int = 10_000,
) -> DataFrame:
    """(record_id, word, tf, df, background, score, specific) of every word of every record.

    The background of a word is its share of all (record, word) rows of the collection, ``df`` the number of records
    that hold it. ``specific`` is the probability that the record's own model gave the word, and ``score`` is the word's share of the record's own model: expectation-maximisation
    gives the background what it explains, so words that are common everywhere lose their mass and what
    sets the record apart keeps it; the scores of a record sum to 1. Words that hold at least one in
    ``one_in`` of all (record, word) rows are at most ``one_in`` by counting and reach the rows by
    broadcast; all other words are joined by a shuffle in which none can be hot. A record
    with more than ``WIDE_RECORD`` distinct words is never gathered into one row. An empty table, or
    fields without words, give no rows; equal words score equally.
    """
    words = record_words(names, fields)
    vocabulary = words.groupBy("word").agg(F.count("*").alias("df"))
    total = vocabulary.agg(F.sum("df").alias("all_df"))
    known = vocabulary.join(F.broadcast(total)).select(
        "word",
        "df",
        (F.col("df") / F.col("all_df")).alias("background"),
        (F.col("df") * one_in >= F.col("all_df")).alias("hot"),
    )
    common = F.broadcast(known.filter("hot").drop("hot"))
    with_common = words.join(common, "word", "left")
    # rows whose word was not among the common ones; the other side lacks those, so none meets twice
    rest = with_common.filter("df is null").select("record_id", "word", "tf").join(
        known.filter("not hot").drop("hot"), "word"
    )
    rows = with_common.filter("df is not null").select("record_id", "word", "tf", "df", "background").unionByName(
        rest.select("record_id", "word", "tf", "df", "background")
    )
    sizes = words.groupBy("record_id").agg(F.count("*").alias("n")).filter(F.col("n") > WIDE_RECORD).select("record_id")
    wide_exists = not sizes.isEmpty()
    usual = rows
    if wide_exists:
        # how many records are that wide grows with the data: their size decides at run time how they are joined
        usual = rows.join(sizes, "record_id", "left_anti")
    gathered = usual.groupBy("record_id").agg(
        F.collect_list(F.struct("word", "tf", "df", "background")).alias("terms")
    )
    scored = gathered.withColumn("p", _converged(F.col("terms"), lam, rounds, settled)).select(
        "record_id", F.explode(F.arrays_zip("terms", "p")).alias("t")
    )
    out = scored.select("record_id", "t.terms.word", "t.terms.tf", "t.terms.df", "t.terms.background", F.col("t.p").alias("score"))
    if wide_exists:
        wide = rows.join(sizes, "record_id", "left_semi")
        out = out.unionByName(_converged_wide(wide, lam, rounds, settled).select(*out.columns))
    own = lam * F.col("score")
    return out.withColumn("specific", own / (own + (1.0 - lam) * F.col("background")))


def shared_rare_words(scored: DataFrame, max_records: int = 3, least: float = SPECIFIC) -> DataFrame:
    """(record_id_a, record_id_b): records that share a word which at most ``max_records`` records hold.

    Candidates are the words that the converged models leave to their records, with a ``specific`` of ``least`` or more; of them the
    number of holders is checked exactly. No such word is lost: a word of k of all N (record, word) rows converges to
    1 - k (1 - lam) S / (lam tf N), where S is at most the number of words of the record, so it stays unless a single record has
    nearly lam / (k (1 - lam)) of all N words (a 27th for three holders). No word brings more than ``max_records`` rows together.
    """
    rare = scored.filter((F.col("specific") >= least) & F.col("df").between(2, max_records))
    held = rare.groupBy("word").agg(F.array_sort(F.collect_set("record_id")).alias("ids"))
    a = held.select("ids", F.posexplode("ids").alias("at", "record_id_a"))
    return a.select(
        "record_id_a", F.explode(F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("record_id_b")
    ).distinct()
