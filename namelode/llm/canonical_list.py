"""Values typed by people mapped to the entries of a reference list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namelode.llm.distance import edit_distance, plain_text
from namelode.session import durable

#: How a direction in a name is also written.
DIRECTIONS = {"north": ("northern", "n"), "south": ("southern", "s"), "east": ("eastern", "e"), "west": ("western", "w")}
#: Share of its tokens that a typed value and an entry must have in common: candidates, not yet matches.
JACCARD = 0.25


def _words(plain: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def pairs_of_letters(text: Column) -> Column:
    """The set of letter pairs of ``text``, its beginning and end marked."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(marked, i, F.lit(2)))
    )


def entry_forms(reference: DataFrame) -> DataFrame:
    """(code, form, kind): the ways to write each entry of the list (code, name).

    kind 'code' for the code, 'name' for the whole name, for the name without the words that describe many
    entries (those in three or more names, such as 'republic' or 'of'), and, where a direction tells
    entries apart, for both orders and the other ways to write the direction; kind 'bones' for the name
    without its vowels. Null names have only their code.
    """
    base = reference.filter(F.col("code").isNotNull()).select(
        "code", plain_text("code").alias("c"), _words(plain_text(F.coalesce("name", F.lit("")))).alias("words")
    )
    common = (
        base.select("code", F.explode(F.array_distinct("words")).alias("w"))
        .groupBy("w")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= 3)
        .agg(F.collect_list("w").alias("common"))
    )
    rows = base.join(F.broadcast(common))
    known = F.create_map(*(F.lit(x) for k in DIRECTIONS for x in (k, k)))
    rows = rows.select(
        "code",
        "c",
        "words",
        F.try_element_at(F.filter("words", lambda w: known[w].isNotNull()), F.lit(1)).alias("direction"),
        F.array_join(F.filter(F.array_except("words", "common"), lambda w: known[w].isNull()), "").alias("core"),
    )
    turned = []
    for name, others in DIRECTIONS.items():
        for d in (name, *others):
            turned += [F.when(F.col("direction") == name, F.concat(F.lit(d), "core")),
                       F.when(F.col("direction") == name, F.concat("core", F.lit(d)))]
    plain_core = F.when(F.col("direction").isNull(), F.col("core"))
    names = F.array(F.array_join("words", ""), plain_core, *turned)
    bones = F.regexp_replace(plain_core, "(?<=.)[aeiouy]", "")
    with_end = F.regexp_replace(plain_core, "(?<=.)[aeiouy](?=.)", "")

    def forms_of(kind: str, texts: Column) -> Column:
        return F.transform(F.array_distinct(texts), lambda f: F.struct(f.alias("form"), F.lit(kind).alias("kind")))

    forms = F.concat(
        forms_of("code", F.array(F.regexp_replace("c", r"[^\p{L}\p{N}]", ""))),
        forms_of("name", names),
        forms_of("bones", F.filter(F.array(bones, with_end), lambda f: F.length(f) >= 4)),
    )
    return (
        rows.select("code", F.explode(forms).alias("f"))
        .select("code", "f.form", "f.kind")
        .filter(F.length("form") >= 3)
        .distinct()
    )


def typed_units(typed: DataFrame) -> DataFrame:
    """(typed, unit): what may be the name in a typed value: each word, up to three in a row, and all of it."""
    words = typed.select("typed", _words(plain_text("typed")).alias("w"))
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))),
            lambda i: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.array_join(F.slice("w", i, n), "")),
        )
    )
    units = F.array_distinct(F.concat(runs, F.array(F.array_join("w", ""))))
    return words.filter(F.size("w") > 0).select("typed", F.explode(units).alias("unit")).filter(F.length("unit") >= 3)


def similar_sets(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(l, r, jaccard) of the texts ``left`` (l) and ``right`` (r) whose letter pairs have that Jaccard or more.

    A prefix-filter join: the pairs of each text are ordered by how rare they are in ``right``; texts can
    only be similar if the first few of each, as many as the threshold leaves, have one in common. Only
    those are joined, sizes and positions must allow the threshold, and the rest is verified exactly.
    """
    l_sets = left.select(F.col("l").alias("key"), pairs_of_letters(F.col("l")).alias("tokens"))
    r_sets = right.select(F.col("r").alias("key"), pairs_of_letters(F.col("r")).alias("tokens"))
    rarity = r_sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))

    def prefixes(sets: DataFrame, side: str) -> DataFrame:
        ranked = (
            sets.select("key", "tokens", F.explode("tokens").alias("token"))
            .join(rarity, "token", "left")
            .groupBy("key", "tokens")
            .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("ordered"))
        )
        size = F.size("ordered")
        first = F.slice("ordered", 1, (size - F.ceil(F.lit(threshold) * size - 1e-9) + 1).cast("int"))
        return ranked.select(
            F.col("key").alias(side), F.col("tokens").alias(f"{side}_set"), F.posexplode(first).alias(f"{side}_at", "t")
        ).withColumn("token", F.col("t.token")).drop("t")

    # few bytes, but very many pairs: both sides are spread by a fixed number, or one task would make them all
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x, y = prefixes(l_sets, "l").repartition(tasks, "token"), prefixes(r_sets, "r").repartition(tasks, "token").hint("shuffle_hash")
    nl, nr = F.size("l_set"), F.size("r_set")
    slight = 1e-9  # so that a bound met exactly isn't missed by rounding
    needed = F.ceil(threshold / (1 + threshold) * (nl + nr) - slight)
    fits = (nr >= threshold * nl - slight) & (nl >= threshold * nr - slight)
    possible = 1 + F.least(nl - F.col("l_at") - 1, nr - F.col("r_at") - 1) + F.least("l_at", "r_at") >= needed
    pairs = x.join(y, "token").filter(fits & possible).select("l", "r", "l_set", "r_set").distinct()
    both = F.size(F.array_intersect("l_set", "r_set"))
    return pairs.withColumn("jaccard", both / (nl + nr - both)).filter(F.col("jaccard") >= threshold - slight).select("l", "r", "jaccard")


def match_values(typed: DataFrame, reference: DataFrame, threshold: float = JACCARD) -> DataFrame:
    """(typed, code): the entry that each distinct typed value means; values that mean none are left out.

    Candidates come from the set-similarity join of the parts of the value with the forms of the entries.
    A candidate holds if the edit distance is small for its length, if one is a beginning of the other
    (an abbreviation, or a name with the ending of its people), or if just its vowels were left out. The
    best is kept: by exact Jaccard, then by distance; a value equally close to two entries means none.
    """
    units = durable(typed_units(typed))
    forms = durable(entry_forms(reference))
    tasks = int(typed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    candidates = similar_sets(
        units.select(F.col("unit").alias("l")).distinct(), forms.select(F.col("form").alias("r")).distinct(), threshold
    ).withColumnsRenamed({"l": "unit", "r": "form"}).repartition(tasks, "unit")
    pairs = candidates.join(forms, "form")
    u, f = F.col("unit"), F.col("form")
    longest = F.greatest(F.length(u), F.length(f))
    budget = (
        F.when(F.col("kind") == "code", F.when(F.length(f) >= 5, 1).otherwise(0))
        .when(F.col("kind") == "name", F.floor(longest / 4))
        .otherwise(0)
        .cast("int")
    )
    far = F.levenshtein(u, f)
    near = pairs.withColumn("most", F.least(budget, F.lit(4))).withColumn("gap", edit_distance(u, f, F.col("most")))
    stem = lambda n: F.substring(u, F.lit(1), F.length(f) - n) == F.substring(f, F.lit(1), F.length(f) - n)
    ending = F.regexp_extract(u, r"(ian|ean|an|n|ese|ish|i|ite|er|ic|nese)$", 1)
    people = (
        (F.col("kind") == "name")
        & (ending != "")
        & F.coalesce(*(F.when(stem(n) & (F.length(f) - n >= 4), True) for n in range(4)), F.lit(False))
        & (F.length(u) - F.length(f) <= 4)
    )
    short = (F.col("kind") != "bones") & f.startswith(u) & (F.length(u) >= 4) & (F.length(u) < F.length(f)) & (F.length(f) - F.length(u) <= 5)
    cost = (
        F.when((F.col("kind") == "bones") & (u == f), 1.5)
        .when(F.col("kind") == "bones", None)
        .when(F.col("gap") <= F.col("most"), F.col("gap").cast("double"))
        .when(people, F.least(F.lit(1.5), far.cast("double")))
        .when(short, 2.0 + (F.length(f) - F.length(u)) / 10.0)
    )
    scored = units.join(near.withColumn("cost", cost).filter(F.col("cost").isNotNull()), "unit")
    by_code = scored.groupBy("typed", "code").agg(
        F.min(F.struct((-F.col("jaccard")).alias("jaccard"), F.col("cost"), (-F.length("unit")).alias("length"))).alias("best")
    )
    ranked = by_code.groupBy("typed").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("best", "code"))), 1, 2).alias("top")
    )
    first, second = F.col("top")[0], F.try_element_at("top", F.lit(2))
    clear = second.isNull() | (first["best"] != second["best"])
    return ranked.filter(clear).select("typed", first["code"].alias("code"))


def mapped_countries(countries: DataFrame, reference: DataFrame, one_in: int = 1000) -> DataFrame:
    """(country_row_id, country_code, country_name, code) of every row whose code is none of the list.

    ``code`` is the entry that country_code means or, failing that, country_name, and '' if neither means
    one: nulls, blanks and values like 'none given' among them. Each distinct value is matched once. A
    value that holds one row in ``one_in`` or more reaches the rows by broadcast (there are at most
    ``one_in`` of them), all others by a shuffle. An
    empty reference list maps every row to ''.
    """
    listed = reference.filter(F.col("code").isNotNull()).select(F.col("code").alias("country_code")).distinct()
    rows = countries.select(F.col("id").alias("country_row_id"), "country_code", "country_name").join(
        listed, "country_code", "left_anti"
    )
    value = F.struct(F.coalesce("country_code", F.lit("")).alias("c"), F.coalesce("country_name", F.lit("")).alias("n"))
    rows = rows.withColumn("v", value)
    counts = rows.groupBy("v").agg(F.count("*").alias("rows_of"))
    typed = counts.select(F.explode(F.array("v.c", "v.n")).alias("typed")).filter(F.trim("typed") != "").distinct()
    found = durable(match_values(typed, reference))
    meant = (
        counts.join(found.select(F.col("typed").alias("tc"), F.col("code").alias("by_code")), F.col("v.c") == F.col("tc"), "left")
        .join(found.select(F.col("typed").alias("tn"), F.col("code").alias("by_name")), F.col("v.n") == F.col("tn"), "left")
        .select("v", "rows_of", F.coalesce("by_code", "by_name", F.lit("")).alias("code"))
    )
    all_rows = counts.agg(F.sum("rows_of").alias("all_rows"))
    weighed = meant.join(F.broadcast(all_rows)).withColumn("hot", F.col("rows_of") * one_in >= F.col("all_rows"))
    hot = weighed.filter("hot").select("v", F.col("code").alias("hot_code"))
    cold = weighed.filter("not hot").select("v", "code")
    served = rows.join(F.broadcast(hot), "v", "left")
    out = ["country_row_id", "country_code", "country_name", "code"]
    frequent = served.filter("hot_code is not null").withColumnRenamed("hot_code", "code").select(*out)
    rest = served.filter("hot_code is null").join(cold, "v").select(*out)
    return frequent.unionByName(rest)
