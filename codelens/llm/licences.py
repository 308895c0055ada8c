"""Licence scan by sentence rules: DataFrame functions only.

A text is cut into sentences: after a sentence mark and a blank, at an empty
line, and at a line that begins with a capitalised word, a digit or a bullet. A
sentence is normalised to lower-case ASCII letters and digits with
single spaces, which also drops the leaders of comment lines; sentences without
any are skipped. Within a sentence every other line break may be a cut, too: a
known sentence is found wherever it begins with a line or sentence and ends with
one, over as many of them as it has words at most. At each place the longest
counts, and none within a longer one before. The identifiers found are matched
against rules: a licence's sentences in their order, with no other known
sentence and at most ``GAP`` unknown ones between two. A match within a longer
one is dropped. Places are numbers of sentences.

Sentences and rules are tables; those of the usual licences come with the library
(``licence_texts``). A ``{}`` in a sentence stands for a holder's name or an address
of at most ``NAME_WORDS`` words. There may be ``MAX_SENTENCES`` sentences, which bounds
what is broadcast; rules are measured.

The result has a row for each match; texts without one have none. Null and empty
texts have no sentences; repeated rows are scanned each; a null id is kept. A text's
hits are gathered in one row, of which there are no more than sentences, also of a
very long text. Only the named columns are read, so others may have any names. An
empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.llm.licence_texts import RULES, SENTENCES
from codelens.plans.layout import broadcast_if_small

GAP = 3
NAME_WORDS = 12  # that a name or an address can have
MAX_SENTENCES = 20_000

BLANK = r"[\x20\x09-\x0D]"
MARK_OR_EMPTY_LINE = rf"[.;:!?]{BLANK}+|\n{BLANK}*\n"
NEW_LINE = rf"\n{BLANK}*([A-Z][a-z]|[0-9*-])"
CUT, LINE = "\x01", "\x02"
NOT_KEPT = f"[^A-Za-z0-9{CUT}{LINE}]+"


def normalise(sentence: str) -> str:
    return re.sub("[^A-Za-z0-9]+", " ", sentence).strip().lower()


def sentence_table(spark: SparkSession) -> DataFrame:
    """``id, text`` of the sentences that come with the library."""
    return spark.createDataFrame(list(SENTENCES.items()), "id string, text string")


def rule_table(spark: SparkSession) -> DataFrame:
    """``licence, rule, ids`` that come with the library."""
    return spark.createDataFrame(RULES, "licence string, rule string, ids array<string>")


def pattern(text: str) -> str | None:
    """What a sentence with names in it matches, followed by a blank; None if it has none."""
    parts = [normalise(part) for part in text.split("{}")]
    names = f" (?:[a-z0-9]+ ){{0,{NAME_WORDS}}}?"
    return f"^({names.join(parts).rstrip()}) " if len(parts) > 1 else None


def longest(texts: list[str]) -> int:
    """Words of the longest sentence."""
    return max((len(normalise(text).split()) + text.count("{}") * NAME_WORDS for text in texts), default=0)


def beginnings(texts: list[str]) -> str:
    """A pattern for what a sentence can begin with: its first words, up to all, and anything from a name on."""
    words = [[word for at, part in enumerate(text.split("{}")) for word in (["{}"] if at else []) + normalise(part).split()] for text in texts]

    def following(depth: int, own: list[list[str]]) -> str:
        nexts: dict[str, list[list[str]]] = {}
        for sentence in own:
            if len(sentence) > depth:
                nexts.setdefault(sentence[depth], []).append(sentence)
        each = ["(?: .*)?" if word == "{}" else (" " if depth else "") + word + following(depth + 1, those) for word, those in nexts.items()]
        return f"(?:{'|'.join(each)}){'?' if depth else ''}" if each else ""

    return f"^{following(0, words)}$"


def lines(text):
    """Normalised lines of a text column, each as ``line`` with ``at``, the number of the sentence it is in."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(MARK_OR_EMPTY_LINE), F.lit(CUT))
    marked = F.regexp_replace(marked, F.lit(NEW_LINE), F.lit(CUT + "$1"))
    marked = F.regexp_replace(F.translate(marked, "\n\r", LINE + LINE), F.lit(NOT_KEPT), F.lit(" "))
    cut = F.filter(F.split(F.lower(marked), CUT), lambda sentence: sentence.rlike("[a-z0-9]"))

    def own_lines(sentence, at):
        return F.transform(F.split(sentence, LINE), lambda line: F.struct(F.trim(line).alias("line"), at.alias("at")))

    return F.filter(F.flatten(F.transform(cut, own_lines)), lambda line: line["line"] != "")


def licence_matches(docs: DataFrame, sentences: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """``doc_id, licence, rule, first_sentence, last_sentence, n_known`` of every match.

    ``sentences`` has ``id, text``, where ``{}`` in a text stands for a name, not at its
    beginning or end; ``rules`` has ``licence, rule, ids``.
    """
    spark = docs.sparkSession
    known = (sentences or sentence_table(spark)).select("id", "text").limit(MAX_SENTENCES + 1).collect()
    if len(known) > MAX_SENTENCES:
        raise ValueError(f"more than {MAX_SENTENCES} sentences")
    known = [row for row in known if normalise(row["text"] or "")]
    texts = [row["text"] for row in known]
    reach = longest(texts)
    cut = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", lines(F.col("text")).alias("lines"))
    # Only lines that a known sentence can begin with get a row, with as many lines as the longest can have.
    numbers = F.transform("lines", lambda line, k: F.when(line["line"].rlike(beginnings(texts)), k))
    places = F.filter(numbers, lambda k: k.isNotNull())
    ahead = F.transform(places, lambda k: F.struct(k.alias("k"), F.slice("lines", k + 1, F.lit(reach)).alias("ahead")))
    each = cut.select("rid", "doc_id", F.inline(ahead))
    each = each.withColumn("tail", F.concat_ws(" ", "ahead.line")).withColumn("word", F.substring_index("tail", " ", 1))
    rows = [(row["id"], normalise(row["text"].replace("{}", " ")), normalise(row["text"]).split()[0], pattern(row["text"])) for row in known]
    table = spark.createDataFrame(rows, "id string, sentence string, word string, pattern string")
    plain = F.when(F.expr("startswith(concat(tail, ' '), concat(sentence, ' '))"), F.col("sentence"))
    named = F.expr("nullif(regexp_extract(concat(tail, ' '), pattern, 1), '')")
    hits = each.join(F.broadcast(table), "word").withColumn("said", F.when(F.col("pattern").isNull(), plain).otherwise(named)).filter("said IS NOT NULL")
    n_lines = "array_position(transform(sequence(1, size(ahead)), n -> length(concat_ws(' ', slice(ahead.line, 1, n)))), length(said))"
    hits = hits.withColumn("n", F.expr(f"cast({n_lines} AS int)")).filter("n > 0")
    # Of two sentences with the same words the one without names counts.
    hits = hits.select("rid", "doc_id", "k", "n", F.col("pattern").isNull().alias("exact"), "id", F.expr("ahead[0].at").alias("at"), F.expr("ahead[n - 1].at").alias("last"))
    found = hits.groupBy("rid", "doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "n", "exact", "id", "at", "last"))).alias("hits"))
    # Sorted by place and length, the longest at a place is the last there.
    ending = F.expr("filter(hits, (hit, i) -> i = size(hits) - 1 OR get(hits, i + 1).k <> hit.k)")
    found = found.select("rid", "doc_id", ending.alias("hits"))
    # A hit that another one holds begins at most the longest sentence's lines after it.
    held = f"slice(hits, greatest(i - {reach} + 1, 1), least(i, {reach}))"
    outer = F.expr(f"filter(hits, (hit, i) -> i = 0 OR NOT exists({held}, before -> before.k + before.n >= hit.k + hit.n))")
    found = found.select("rid", "doc_id", outer.alias("hits"))
    starts = found.select("rid", "doc_id", "hits", F.posexplode("hits").alias("i", "hit")).withColumn("first", F.col("hit.id"))
    asked = (rules or rule_table(spark)).select("licence", "rule", "ids").withColumn("first", F.get("ids", F.lit(0)))
    matches = starts.join(broadcast_if_small(asked), "first").filter("transform(slice(hits, i + 1, size(ids)), hit -> hit.id) = ids").filter(
        f"""forall(zip_with(slice(hits, i + 2, size(ids) - 1), slice(hits, i + 1, size(ids) - 1),
                            (later, hit) -> later.k >= hit.k + hit.n AND later.at - hit.last - 1 <= {GAP}), fits -> fits)"""
    )
    matches = matches.select(
        "rid",
        "doc_id",
        "licence",
        "rule",
        F.col("hit.at").alias("first_sentence"),
        F.expr("element_at(hits, i + size(ids)).last").alias("last_sentence"),
        F.size("ids").alias("n_known"),
        F.col("hit.k").alias("first_line"),
        F.expr("element_at(hits, i + size(ids)).k + element_at(hits, i + size(ids)).n - 1").alias("last_line"),
    )
    longer_before = "max(last_line) OVER (PARTITION BY rid ORDER BY first_line, last_line DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    kept = matches.withColumn("covered", F.expr(longer_before)).filter("covered IS NULL OR last_line > covered")
    return kept.drop("rid", "covered", "first_line", "last_line")
