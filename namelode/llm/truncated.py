"""Texts cut off by field limits or broken transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namelode.session import durable

_BLANKS = " \\t\\n\\r\\u00a0\\u2007\\u202f\\u3000\\u200b\\ufeff"
#: What a system puts where it left something out.
CUT_MARK = (
    r"(\((more|cont(inued|d|\.)?|truncated|cut|\.{3}|…)\)|\[(more|continued|truncated|cut|snip|\.{3}|…)\]"
    r"|…|\.{3,}|\x{FFFD}|>>>?)$"
)
#: A sentence's end in the scripts of the corpus, with what may close after it.
SENTENCE_END = r"[.!?؟۔。！？।][\"'”“’»«)\]}*_]*$"
#: After a field limit, a full stop behind one or two digits may be the inside of a date or number.
NUMBER_STOP = r"(^|[^\d.,/-])\d{1,2}\.(\d{1,2}\.)?$"


def measures(text: Column) -> dict[str, Column]:
    """The lengths that a field limit may have counted, in order of preference."""
    chars = F.char_length(text).cast("int")
    octets = F.octet_length(text).cast("int")
    lone_breaks = F.regexp_count(text, F.lit(r"(?<!\r)\n"))
    entities = (
        4 * F.regexp_count(text, F.lit("&")) + 3 * F.regexp_count(text, F.lit("[<>]")) + 5 * F.regexp_count(text, F.lit("[\"']"))
    )
    escapes = F.regexp_count(text, F.lit(r'["\\\n\r\t]'))
    # characters outside the first plane take two units, and only they take four bytes
    wide = F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return {
        "characters": chars,
        "utf8_bytes": octets,
        "utf16_units": (chars + wide).cast("int"),
        "characters_crlf": (chars + lone_breaks).cast("int"),
        "utf8_bytes_crlf": (octets + lone_breaks).cast("int"),
        "characters_entities": (chars + entities).cast("int"),
        "utf8_bytes_entities": (octets + entities).cast("int"),
        "characters_json": (chars + escapes).cast("int"),
        "utf8_bytes_json": (octets + escapes).cast("int"),
    }


def _masked(text: Column) -> Column:
    """``text`` with numbers as 9 and codes of capitals as A, so that like line ends look alike."""
    return F.regexp_replace(F.regexp_replace(text, r"\d+", "9"), r"\b[A-Z]{2,3}-(?=9)", "A-")


def endings(docs: DataFrame) -> DataFrame:
    """One narrow row for each text that is not null, empty or blank: its lengths and how it ends.

    ``ending`` is 'mark', 'structure' (a JSON object that doesn't close), 'sentence', 'line' (a last line
    of its own without a sentence's end) or 'open'. ``label`` and ``tail`` describe such a last line.
    """
    text = F.col("text")
    trimmed = F.expr(f"rtrim('{_BLANKS}', text)")
    end = F.right(F.col("trimmed"), F.lit(200))
    last_line = F.trim(F.substring_index(F.col("trimmed"), "\n", -1))
    rows = docs.select("doc_id", "source", "text").withColumn("trimmed", trimmed).filter(F.col("trimmed") != "")
    rows = rows.select("doc_id", "source", "text", end.alias("end"), F.right(last_line, F.lit(200)).alias("last_line"),
                       (last_line != F.col("trimmed")).alias("own_line"), F.expr(f"ltrim('{_BLANKS}', text)").alias("start"))
    line = F.col("last_line")
    label = (
        F.when(line.contains("\t"), F.concat(F.substring_index(line, "\t", 1), F.lit("\t")))
        .when(line.rlike(r"^\[.*\]$"), "[]")
        .when(line.rlike(r"^[-*•·–] "), "- ")
        .when(line.rlike(r"^— "), "— ")
        .when(line.rlike(r"^\p{L}[\p{L} ]{0,24}: \S"), F.concat(F.substring_index(line, ":", 1), F.lit(":")))
    )
    final = _masked(F.substring_index(F.regexp_replace(line, r"\s+", " "), " ", -1))
    whole = _masked(line)
    structure = F.substring(F.col("start"), 1, 1) == "{"
    ending = (
        F.when(F.col("end").rlike(CUT_MARK), "mark")
        .when(structure, F.when(F.col("end").endswith("}"), "sentence").otherwise("structure"))
        .when(F.col("end").rlike(SENTENCE_END), "sentence")
        .when(F.col("own_line") & (F.length(line) <= 120), "line")
        .otherwise("open")
    )
    return rows.select(
        "doc_id",
        "source",
        F.struct(*(m.alias(k) for k, m in measures(text).items())).alias("lengths"),
        ending.alias("ending"),
        F.col("end").rlike(NUMBER_STOP).alias("number_stop"),
        F.when(ending == "line", F.coalesce(label, F.lit(""))).alias("label"),
        F.when(ending == "line", F.when(label.isNotNull(), final).otherwise(whole)).alias("tail"),
    )


def hidden_limits(ends: DataFrame, least: int = 5, least_share: float = 0.5) -> DataFrame:
    """(source, measure, limit, texts, cut_off): lengths at which texts of a source break off.

    For each source and way of counting, a length is a limit where ``least`` texts or more of exactly that
    length end openly, and these are ``least_share`` of its texts or more. Of the ways of counting, the
    one with most such texts is kept for each source. Only counts by (source, measure, length) are
    shuffled, after partial aggregation.
    """
    open_end = F.col("ending").isin("open", "mark", "structure")
    names = [f.name for f in ends.schema["lengths"].dataType.fields]
    each = F.explode(
        F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(m).alias("measure"), F.col(f"lengths.{m}").alias("limit")) for i, m in enumerate(names)))
    )
    counted = (
        ends.select("source", open_end.alias("open_end"), each.alias("m"))
        .groupBy("source", "m.rank", "m.measure", "m.limit")
        .agg(F.count("*").alias("texts"), F.count_if("open_end").alias("cut_off"))
        .filter((F.col("cut_off") >= least) & (F.col("cut_off") >= least_share * F.col("texts")))
    )
    by_measure = counted.groupBy("source", "rank", "measure").agg(
        F.sum("cut_off").alias("weight"), F.collect_list(F.struct("limit", "texts", "cut_off")).alias("limits")
    )
    best = by_measure.groupBy("source").agg(
        F.max_by(F.struct("measure", "limits"), F.struct("weight", -F.col("rank"))).alias("b")
    )
    return best.select("source", "b.measure", F.explode("b.limits").alias("l")).select(
        "source", "measure", "l.limit", "l.texts", "l.cut_off"
    )


def truncated_texts(docs: DataFrame, slack: int = 4, least_share: float = 0.005, least: int = 3) -> DataFrame:
    """(doc_id, source, cut, reason, measure, limit) of every text that is not null, empty or blank.

    The lengths of all texts under every way of counting show which limits their sources have; the endings
    then decide. Cut are texts that end in a mark of omission, inside a JSON object, or otherwise without a
    sentence's end, unless their last line is complete in itself: a line whose label and last word (or
    whole form, without a label) many texts share, or whose label stands before ever new words such as
    names. At a limit (within ``slack``, for a last character that didn't fit or blanks that were trimmed)
    such a line, or a full stop behind one or two digits, does not count as an end. A null source is a
    source of its own; repeated texts each have their row.
    """
    ends = durable(endings(docs).withColumn("source", F.coalesce("source", F.lit(""))))
    limits = hidden_limits(ends).groupBy("source", "measure").agg(F.collect_set("limit").alias("limits"))
    names = [f.name for f in ends.schema["lengths"].dataType.fields]
    near = ends.join(limits, "source", "left")
    length = F.coalesce(*(F.when(F.col("measure") == m, F.col(f"lengths.{m}")) for m in names))
    limit = F.array_max(F.filter("limits", lambda x: (length >= x - slack) & (length <= x + slack)))
    near = near.withColumn("limit", limit)

    lines = ends.filter("ending = 'line'").groupBy("label", "tail").agg(F.count("*").alias("n"))
    labels = lines.groupBy("label").agg(F.sum("n").alias("all_n"), F.count("*").alias("kinds"))
    # a label before ever new words: most of its last words occur once
    open_labels = labels.filter((F.col("label") != "") & (F.col("kinds") > 0.3 * F.col("all_n")) & (F.col("all_n") >= least))
    common = lines.join(labels, "label").filter(
        (F.col("n") >= least) & (F.col("n") >= least_share * F.col("all_n"))
    )
    # at most 1 / least_share tails for each label are common
    proper = common.select("label", "tail", F.lit(True).alias("common"))
    ever_new = open_labels.select("label", F.lit(True).alias("ever_new"))
    judged = near.join(proper, ["label", "tail"], "left").join(ever_new, "label", "left")
    at_limit = F.col("limit").isNotNull()
    ended_line = F.coalesce(F.col("common") | F.col("ever_new"), F.lit(False)) & ~at_limit
    reason = (
        F.when(F.col("ending") == "mark", "omission mark")
        .when(F.col("ending") == "structure", "open structure")
        .when((F.col("ending") == "sentence") & at_limit & F.col("number_stop"), "number at the limit")
        .when(F.col("ending") == "sentence", F.lit(None))
        .when((F.col("ending") == "line") & ended_line, F.lit(None))
        .when(at_limit, "open end at the limit")
        .otherwise("open end")
    )
    return judged.select(
        "doc_id",
        "source",
        reason.isNotNull().alias("cut"),
        reason.alias("reason"),
        F.when(at_limit, F.col("measure")).alias("measure"),
        "limit",
    )


def truncation_by_source(docs: DataFrame) -> DataFrame:
    """(source, texts, cut_texts, cut_share): how often each source truncates; blank texts don't count."""
    return (
        truncated_texts(docs)
        .groupBy("source")
        .agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut_texts"))
        .withColumn("cut_share", F.round(F.col("cut_texts") / F.col("texts"), 6))
    )
