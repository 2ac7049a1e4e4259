"""Benchmark decontamination by a distributed positional inverted index.

Everything is DataFrame operations.  The index holds postings (term, document,
position) of corpus words.  The benchmark's windows (ten consecutive words; a
shorter item is one window) are ranked by how rare their terms are in the
corpus.  Lists are shifted by their term's offset in the window and intersected
from the rarest on: first the two rarest lists of each window, whose terms alone
are indexed for the whole corpus; then the remaining lists, indexed only for the
documents that are left.  A window occurs where every one of its lists has its
position.  A window with a term that the corpus lacks can't occur.

Defined results: null, empty and wordless texts have no words and no hits; an
item without words has no window; repeated rows each give a row; rows with one
id but different texts are told apart; an empty table on either side gives no
hits; extra columns are ignored, and kept by decontaminate(), whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrel.llm.common import materialise, measured, unused

WINDOW = 10
#: Stands behind the last word of a document; no word is empty.
END = ""

# What parts words (upper case counts as its lower case), and the letters lower-cased.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text in order, case kept."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SEPARATOR, -1), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are; lower() does the same, faster, where all are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id with a hash of the text: tells apart rows that share an id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), words(F.col("text")).alias("words"))


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, wtext, wlen): each item's windows, in exact lower case."""
    items = benchmark.select(F.col("item_id"), F.transform(words(F.col("text")), ascii_lower).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    at = items.select("item_id", "w", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - size, F.lit(0)))).alias("k"))
    part = F.slice("w", F.col("k") + 1, size)
    return at.select("item_id", F.array_join(part, " ").alias("wtext"), F.least("n", F.lit(size)).alias("wlen")).distinct()


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, freq): occurrences of each of terms among all words of docs."""
    found = docs.select(F.explode(words(F.col("text"))).alias("w")).select(ascii_lower(F.col("w")).alias("term"))
    return found.join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def build_index(docs: DataFrame, terms: DataFrame | None = None, ends: bool = False) -> DataFrame:
    """(term, doc_id, th, pos): a posting per occurrence.

    terms (column term, no value twice, hinted if small) limits the index to these; None indexes all.
    ends adds a posting of END behind each document's last word, if terms has END.
    """
    words_ = F.array_append("words", F.lit(END)) if ends else F.col("words")
    tokens = _keyed(docs).select("doc_id", "th", F.posexplode(words_).alias("pos", "w"))
    tokens = tokens.select(ascii_lower(F.col("w")).alias("term"), "doc_id", "th", "pos")
    return tokens if terms is None else tokens.join(terms, "term")


def plan_windows(distinct: DataFrame, counts: DataFrame) -> DataFrame:
    """(wtext, wlen, t1, o1, t2, o2, rest) of each window that can occur: its terms with their offsets, from the rarest on; rest: array<struct<o, term>>."""
    parts = distinct.select("wtext", "wlen", F.posexplode(F.split("wtext", " ")).alias("o", "term"))
    known = parts.join(counts, "term", "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "term", "o")))  # as many as a window has words
    ranked = known.groupBy("wtext", "wlen").agg(order.alias("r")).where(F.col("r")[0]["freq"] > 0)
    second = F.coalesce(F.get("r", F.lit(1)), F.get("r", F.lit(0)))
    rest = F.transform(F.slice("r", 3, WINDOW), lambda x: F.struct(x["o"].alias("o"), x["term"].alias("term")))
    return ranked.select("wtext", "wlen", F.col("r")[0]["term"].alias("t1"), F.col("r")[0]["o"].alias("o1"), second["term"].alias("t2"), second["o"].alias("o2"), rest.alias("rest"))


def _met(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of wanted (term, doc_id, th, at, ...) whose term has a posting at position at of the document."""
    have = index.select(F.col("term").alias("t"), F.col("doc_id").alias("d"), F.col("th").alias("h"), F.col("pos").alias("p"))
    same = (F.col("term") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")) & (F.col("at") == F.col("p"))
    return wanted.join(have, same, "left_semi")


def rarest_meet(index: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, th, start, wtext, wlen, rest): windows whose two rarest lists meet there.

    Windows that share the two terms and their distance are intersected once.
    """
    pairs = plan.select("t1", "t2", (F.col("o2") - F.col("o1")).alias("gap")).distinct()
    first = index.join(pairs, F.col("term") == F.col("t1")).select("doc_id", "th", "pos", "t1", F.col("t2").alias("term"), "gap", (F.col("pos") + F.col("gap")).alias("at"))
    here = _met(first, index).select("doc_id", "th", "pos", "t1", F.col("term").alias("t2"), "gap").distinct()
    return here.join(plan.withColumn("gap", F.col("o2") - F.col("o1")), ["t1", "t2", "gap"]).where(F.col("pos") >= F.col("o1")).select(
        "doc_id", "th", (F.col("pos") - F.col("o1")).alias("start"), "wtext", "wlen", "rest")


def all_meet(left: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, th, start, wtext, wlen): rows of left all of whose remaining lists, those of rest, meet at start too."""
    key = ["doc_id", "th", "start", "wtext", "wlen"]
    wanted = left.select(*key, F.size("rest").alias("n"), F.explode("rest").alias("x")).select(*key, "n", F.col("x.term").alias("term"), (F.col("start") + F.col("x.o")).alias("at"))
    full = _met(wanted, index).groupBy(*key, "n").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") == F.col("n")).select(*key)
    return left.where(F.size("rest") == 0).select(*key).unionByName(full)


def proximity_matches(index: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """(doc_id, th, a, b, pos_a, pos_b): terms of pairs (a, b) at most slop words apart, not one and the same word.

    The lists meet in stretches of slop + 1 positions: a posting looks into its own and the two beside it.
    """
    width = slop + 1
    here = index.join(pairs.select("a", "b").distinct(), F.col("term") == F.col("a")).select("doc_id", "th", "a", "b", F.col("pos").alias("pos_a"))
    looks = here.withColumn("part", F.explode(F.sequence(F.floor(F.col("pos_a") / width) - 1, F.floor(F.col("pos_a") / width) + 1)))
    other = index.select(F.col("term").alias("t"), F.col("doc_id").alias("d"), F.col("th").alias("h"), F.col("pos").alias("pos_b"), F.floor(F.col("pos") / width).alias("p"))
    same = (F.col("b") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")) & (F.col("part") == F.col("p"))
    close = (F.abs(F.col("pos_a") - F.col("pos_b")) <= slop) & (F.col("pos_a") != F.col("pos_b"))
    return looks.join(other.distinct(), same).where(close).select("doc_id", "th", "a", "b", "pos_a", "pos_b").distinct()


def proximity(docs: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """proximity_matches of docs, from an index of the terms of pairs (a, b: lower-case words) alone."""
    terms = pairs.select(F.explode(F.array("a", "b")).alias("term")).distinct()
    return proximity_matches(materialise(build_index(docs, measured(terms, "terms")), "postings"), pairs, slop)


def matches(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occurrences (doc_id, th, start, wtext, wlen) of benchmark windows in docs; (item_id, wtext, wlen) of the windows; (doc_id, th, n_words) of docs."""
    wins = materialise(windows(benchmark), "windows")
    distinct = wins.select("wtext", "wlen").distinct()
    terms = measured(distinct.select(F.explode(F.split("wtext", " ")).alias("term")).distinct(), "window-terms")
    plan = materialise(plan_windows(distinct, term_counts(docs, terms)), "window-plan")
    rarest = plan.select(F.explode(F.array("t1", "t2")).alias("term")).unionByName(docs.sparkSession.range(1).select(F.lit(END).alias("term")))
    index = materialise(build_index(docs, measured(rarest.distinct(), "rarest-terms"), ends=True), "postings")
    sizes = index.where(F.col("term") == END).select("doc_id", "th", F.col("pos").cast("long").alias("n_words"))
    left = materialise(rarest_meet(index, plan), "window-starts")
    # Only the documents that are left are split into words again.
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    held = measured(left.where(F.size("rest") > 0).select(F.col("th").alias("h")).distinct(), "window-documents")
    others = measured(plan.select(F.explode("rest.term").alias("term")).distinct(), "other-terms")
    rest = build_index(docs.select("doc_id", "text").join(held, th == F.col("h"), "left_semi"), others)
    return all_meet(left, rest), wins, sizes


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs."""
    found, wins, base = matches(docs, benchmark)
    found = materialise(found, "matches")
    mine = Window.partitionBy("doc_id", "th").orderBy("start", "wlen")
    before = F.coalesce(F.max(F.col("start") + F.col("wlen")).over(mine.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    end = F.col("start") + F.col("wlen")
    spans = found.select("doc_id", "th", "start", "wlen").distinct().withColumn("new", F.greatest(F.lit(0), end - F.greatest("start", before)))
    hits = spans.groupBy("doc_id", "th").agg(F.sum("new").alias("n_hit"))
    items = found.select("doc_id", "th", "wtext").distinct().join(wins.select("item_id", "wtext"), "wtext").select("doc_id", "th", F.col("item_id").cast("string").alias("i")).distinct()
    items = items.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list("i")).alias("i"))  # at most the benchmark's items
    per = hits.join(items, hits["doc_id"].eqNullSafe(items["doc_id"]) & (hits["th"] == items["th"])).select(hits["doc_id"].alias("d2"), hits["th"].alias("th2"), "n_hit", "i")
    return base.join(per, base["doc_id"].eqNullSafe(per["d2"]) & (base["th"] == per["th2"]), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("i"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("i", F.array().cast("array<string>")), ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no benchmark window occurs, with all their columns."""
    d, t = unused(docs, "doc", "th")
    found = matches(docs, benchmark)[0]
    bad = measured(found.select(F.col("doc_id").alias(d), F.col("th").alias(t)).distinct(), "contaminated")
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (th == F.col(t)), "left_anti")
