"""Finding the name rows that a searched name may mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namelode.functions import names as nm
from namelode.session import durable, nullif_empty

#: Characters that a searched name loses, without leaving a blank.
SEARCH_MARKS = r"""[+\-><()~*"\\@.,;:!?']"""
NAME_COLUMNS = ("first_name", "middle_name", "surname", "single_string_name", "original_script_name", "entity_name")
#: Name rows taken for each search, best first.
ROW_LIMIT = 300
#: Letters by which the words of a LIKE search are looked up.
GRAM = 6


def search_tokens(name: Column) -> Column:
    """The words of a searched name of two letters or more, as they are written."""
    words = F.split(F.regexp_replace(name, SEARCH_MARKS, ""), f"{nm.SPACE}+")
    return F.filter(words, lambda w: F.length(w) >= 2)


def term_groups(tokens: Column, broad: bool = False) -> Column:
    """An array of (pos, token, variant, required): the words as prefixes, some of which must occur.

    Half of the words that are no connectors, rounded up, are required (one if ``broad``), the longest first
    and earlier ones of equal length first. ``variant`` is the word without its article, '' if it has none.
    """
    each = F.transform(tokens, lambda t, i: F.struct(i.alias("pos"), t.alias("token"), nm.article_variant(t).alias("variant"),
                                                     nm.normalize(t).isin(*nm.CONNECTORS).alias("connector")))
    return nm.let(each, lambda groups: _with_required(groups, broad))


def _with_required(each: Column, broad: bool) -> Column:
    telling = F.filter(each, lambda t: ~t["connector"])
    ordered = F.array_sort(F.transform(telling, lambda t: F.struct((-F.length(t["token"])).alias("l"), t["pos"].alias("pos"))))
    wanted = F.least(F.lit(1), F.size(telling)) if broad else F.floor((F.size(telling) + 1) / 2).cast("int")
    required = F.transform(F.slice(ordered, 1, wanted), lambda t: t["pos"])
    return nm.let(required, lambda must: F.transform(each, lambda t: F.struct(
        t["pos"].alias("pos"), t["token"].alias("token"), t["variant"].alias("variant"), F.array_contains(must, t["pos"]).alias("required")
    )))


def boolean_query(groups: Column) -> Column:
    """The groups as a full-text query: + before required ones, * behind prefixes, variants in brackets."""
    def text(g: Column) -> Column:
        prefix = F.concat(g["token"], F.lit("*"))
        both = (g["variant"] != "") & (g["variant"] != g["token"])
        shown = F.when(both, F.concat(F.lit("("), prefix, F.lit(" "), g["variant"], F.lit("*)"))).otherwise(prefix)
        return F.concat(F.when(g["required"], "+").otherwise(""), shown)

    return F.array_join(F.transform(groups, text), " ")


def name_terms(names: DataFrame) -> DataFrame:
    """(name_id, record_id, terms): the distinct words of all columns of each name row, in lower case."""
    text = F.lower(F.concat_ws(" ", *NAME_COLUMNS))
    terms = F.array_distinct(F.filter(F.split(text, r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != ""))
    return names.select(F.col("id").alias("name_id"), "record_id", terms.alias("terms"))


def searchable(names: DataFrame, records: DataFrame, search_type: str = "") -> DataFrame:
    """Name rows of active records: of entities, of individuals, or of both for any other type."""
    kinds = {"entity": ("Entity",), "individual": ("Individual", "Person")}.get(search_type)
    active = records.filter("active_status = 'Active'")
    if kinds:
        active = active.filter(F.col("record_type").isin(*kinds))
    return names.join(active.select(F.col("id").alias("record_id")), "record_id", "left_semi")


def matching_rows(queries: DataFrame, names: DataFrame, broad: bool = False, limit: int = ROW_LIMIT) -> DataFrame:
    """(query_id, name_id, record_id, relevance): name rows in which all required words of a query begin a word.

    Where no word is required one must. The words are first joined to the distinct terms of the names, on their
    first two letters and then in full; only the postings of the required word with the fewest rows are read,
    and the other words are looked for in the rows these bring. So a word that a third of all rows hold is
    read only where a query has no rarer one. Relevance sums the rarity of the matched words; the best
    ``limit`` rows of each query are kept, ties by record and row. Queries without words match nothing.
    """
    groups = durable(queries.select("query_id", term_groups(search_tokens(F.col("name")), broad).alias("groups")).filter(F.size("groups") > 0))
    rows = name_terms(names)
    posted = rows.select("name_id", "record_id", F.explode("terms").alias("term"))
    vocabulary = posted.groupBy("term").agg(F.count("*").alias("df"))
    spellings = F.array_distinct(F.array_compact(F.array(F.lower(F.col("g.token")), nullif_empty(F.lower(F.col("g.variant"))))))
    words = groups.select("query_id", F.explode("groups").alias("g")).select(
        "query_id", F.col("g.pos").alias("pos"), F.col("g.required").alias("required"), F.explode(spellings).alias("prefix")
    )
    terms = vocabulary.withColumn("p2", F.substring("term", 1, 2))
    met = words.withColumn("p2", F.substring("prefix", 1, 2)).join(terms, "p2").filter(F.col("term").startswith(F.col("prefix")))
    met = met.select("query_id", "pos", "required", "term", "df").distinct()
    sizes = met.groupBy("query_id", "pos", "required").agg(F.sum("df").alias("rows_of"))
    by_query = Window.partitionBy("query_id")
    has_required = words.groupBy("query_id").agg(F.max(F.col("required").cast("int")).alias("must"))
    first = F.row_number().over(by_query.orderBy("rows_of", "pos"))
    pivots = sizes.filter("required").withColumn("n", first).filter("n = 1").select("query_id", "pos")
    any_word = sizes.join(has_required.filter("must = 0"), "query_id", "left_semi").select("query_id", "pos")
    read = met.join(pivots.unionByName(any_word), ["query_id", "pos"], "left_semi").select("query_id", "term").distinct()
    found = read.join(posted, "term").select("query_id", "name_id", "record_id").distinct()
    weighed = words.join(sizes.select("query_id", "pos", "rows_of"), ["query_id", "pos"], "left").groupBy("query_id").agg(
        F.collect_list(F.struct("pos", "prefix", "required", F.coalesce("rows_of", F.lit(0)).alias("rows_of"))).alias("words")
    )
    checked = found.join(weighed, "query_id").join(rows.select("name_id", "terms"), "name_id")
    holds = lambda w: F.exists("terms", lambda t: t.startswith(w["prefix"]))
    hit = checked.withColumn("hit", F.filter("words", holds))
    hit_at = F.transform("hit", lambda w: w["pos"])
    all_required = F.forall("words", lambda w: ~w["required"] | F.array_contains(hit_at, w["pos"]))
    by_word = F.array_distinct(F.transform("hit", lambda w: F.struct(w["pos"].alias("pos"), w["rows_of"].alias("n"))))
    relevance = F.aggregate(by_word, F.lit(0.0), lambda a, w: a + 1.0 / (1.0 + F.log1p(w["n"].cast("double"))))
    scored = hit.filter(all_required).select("query_id", "name_id", "record_id", F.round(relevance, 9).alias("relevance"))
    at = F.row_number().over(by_query.orderBy(F.desc("relevance"), "record_id", "name_id"))
    return scored.withColumn("n", at).filter(F.col("n") <= limit).drop("n")


def retrieved_rows(queries: DataFrame, names: DataFrame, limit: int = ROW_LIMIT) -> DataFrame:
    """The precise matches of each query, or where it has none the broad ones."""
    precise = durable(matching_rows(queries, names, False, limit))
    left = queries.join(precise.select("query_id").distinct(), "query_id", "left_anti")
    return precise.unionByName(matching_rows(left, names, True, limit))


def like_rows(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, name_id, record_id): all rows that hold enough words of a query anywhere in their columns.

    Both words of two, else half of them rounded up; a word that a query has twice counts twice. No word holds a
    blank, so a row holds it if one of the row's own words does: the distinct words of queries and rows meet once,
    by their first ``GRAM`` letters at any place. A query reads only the rows of its rarest words, those that every
    match must hold one of, and looks for the others there. % and _ in a word stay wildcards, see ``_wildcard_rows``.
    Queries without words match nothing.
    """
    tokens = queries.select("query_id", F.transform(search_tokens(F.col("name")), F.lower).alias("tokens")).filter(F.size("tokens") > 0)
    least = F.when(F.size("tokens") <= 2, F.size("tokens")).otherwise(F.floor((F.size("tokens") + 1) / 2))
    asked = durable(tokens.withColumn("least", least))
    wild = F.exists("tokens", lambda t: t.rlike("[%_]"))
    plain = _plain_rows(asked.filter(~wild), names)
    return plain if asked.filter(wild).isEmpty() else plain.unionByName(_wildcard_rows(asked.filter(wild), names))


def _plain_rows(asked: DataFrame, names: DataFrame) -> DataFrame:
    """``like_rows`` of queries (query_id, tokens, least) without wildcards."""
    spread = 4 * asked.sparkSession.sparkContext.defaultParallelism
    lower = F.concat_ws(" ", *(F.lower(c) for c in NAME_COLUMNS))
    own = F.array_distinct(F.filter(F.split(lower, f"{nm.SPACE}+"), lambda w: w != ""))
    rows = names.select(F.col("id").alias("name_id"), "record_id", own.alias("own"))
    vocabulary = rows.select(F.explode("own").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    words = asked.select("query_id", "least", F.explode("tokens").alias("token")).groupBy("query_id", "least", "token").agg(F.count("*").alias("times"))
    keys = words.select("token", F.substring("token", 1, GRAM).alias("gram")).distinct()

    def grams(n: int) -> Column:
        places = F.when(F.length("word") >= n, F.sequence(F.lit(1), F.length("word") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.substring(F.col("word"), i, F.lit(n)))

    cut = vocabulary.select("word", "df", F.explode(F.array_distinct(F.concat(*(grams(n) for n in range(2, GRAM + 1))))).alias("gram"))
    met = durable(cut.join(keys, "gram").filter(F.contains("word", "token")).select("token", "word", "df"))
    sizes = words.join(met.groupBy("token").agg(F.sum("df").alias("rows_of")), "token", "left")
    passed = F.sum("times").over(Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("rows_of", F.lit(0))), "token"))
    read = sizes.withColumn("passed", passed).filter(F.col("passed") >= F.col("least")).select("query_id", "token")
    sought = asked.join(read.groupBy("query_id").agg(F.collect_list("token").alias("read")), "query_id")
    sought = sought.select("*", F.explode("read").alias("token")).join(met, "token").select("query_id", "tokens", "least", "read", "word").distinct()
    posted = rows.select("name_id", "record_id", "own", F.explode("own").alias("word"))
    found = posted.repartition(spread, "word").join(sought.repartition(spread, "word"), "word").withColumn("text", F.array_join("own", " "))
    enough = F.size(F.filter("tokens", lambda t: F.contains("text", t))) >= F.col("least")
    first = F.get(F.filter("own", lambda w: F.exists("read", lambda t: F.contains(w, t))), F.lit(0))  # a row comes by each of its words that are read
    return found.filter(enough).filter(first == F.col("word")).select("query_id", "name_id", "record_id")


def _wildcard_rows(asked: DataFrame, names: DataFrame, block: int = 500) -> DataFrame:
    """``like_rows`` of queries (query_id, tokens, least) with wildcards: every row is held against every query.

    The queries, few as they are, go to the rows in blocks of about ``block``.
    """
    texts = names.select(F.col("id").alias("name_id"), "record_id", F.transform(F.array(*NAME_COLUMNS), F.lower).alias("texts"))
    within = lambda t: F.exists("texts", lambda x: F.like(x, F.concat(F.lit("%"), t, F.lit("%"))))
    enough = F.size(F.filter("tokens", within)) >= F.col("least")
    blocks = max(1, -(-asked.count() // block))
    met = None
    for n in range(blocks):
        part = F.broadcast(asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n))
        found = texts.join(part, enough).select("query_id", "name_id", "record_id")
        met = found if met is None else met.unionByName(found)
    return met


def variants(names: DataFrame) -> DataFrame:
    """(name_id, record_id, ord, name): the forms of each name row, without repeats in another case.

    In order: the entity name, the name parts in a row, the single string, the original script, and that in
    Latin letters if it is Arabic.
    """
    parts = F.concat_ws(" ", *(nullif_empty(F.col(c)) for c in ("first_name", "middle_name", "surname")))
    original = F.col("original_script_name")
    forms = F.array("entity_name", parts, "single_string_name", original, F.when(nm.is_arabic(original), nm.transliterate(original)))
    clean = F.transform(forms, lambda n: F.regexp_replace(F.coalesce(n, F.lit("")), f"^{nm.SPACE}+|{nm.SPACE}+$", ""))
    first = nm.let(clean, lambda all_forms: F.filter(
        all_forms, lambda n, i: (n != "") & ~F.exists(F.slice(all_forms, 1, i), lambda o: F.lower(o) == F.lower(n))
    ))
    return names.select(F.col("id").alias("name_id"), "record_id", F.posexplode(first).alias("ord", "name"))
