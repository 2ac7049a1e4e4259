"""Personal data: base patterns, and information-theoretic sanitisation of telling terms.

Everything is DataFrame operations.  Base spans come from patterns, as do
secrets (keys, tokens, passwords).  A protected entity stands in the corpus at
three levels: its value, its class (an e-mail's domain, an address's first half,
a card's issuer, a number's prefix) and its kind.  A term anywhere in an
entity's documents, at whatever distance, reveals a share PMI(entity; term) /
IC(entity) of its information, where IC = log2(N / df(entity)) and PMI = log2(N
df(entity, term) / (df(entity) df(term))).  All counts, N included, are of
distinct texts, over the whole corpus, so that copies are no evidence.  Classes
and kinds stand in many texts by chance, so there the share rests on the lower
end of Wilson's interval for P(entity | term), from as many cases as there are
different values: near copies, which repeat a value, count once.  With evidence
from SUPPORT texts, a term is telling from the share GENERALISE on, wherever it
stands in the texts of that entity.  Over FEW words and over COPIED of the text's
words that would tell of one entity mark near copies: each of these words is
held once more against the evidence, in which all the entity's texts so marked
count as one, and tells in them only if it still does.  sanitise() replaces it by the beginning of the word if
that reveals less than GENERALISE, else by [TERM]; from REMOVE on it goes.
Words inside base spans and secrets are no terms.

Words are runs of two or more letters, marks and digits with a letter; scripts
that don't part words give terms of two characters.

Defined results: a null or empty text has no spans; a span is start and end in
code points, end exclusive; spans of several kinds may overlap; repeated rows
each give a row; rows with one id but different texts are told apart; an empty
table gives none; extra columns are kept by sanitise(), whatever their names,
and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrel.llm.common import materialise, measured, quoted, unused

# The kinds in order, and their patterns.  Look-behind and
# possessive repeats only avoid quadratic retries; they match the same spans as
# the plain forms, because what follows a repeat is never in its class.
KINDS = ("email", "ip", "card", "phone", "secret", "term")
BASE, SECRET, TERM = 4, 4, 5
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Public forms of keys; and a name that says secret, with the value assigned to it, which holds a digit.  The span is the value.
    "secret": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,255}+|xox[abprs]-[A-Za-z0-9-]{10,255}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)"
              r"|(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]key|private[_-]key)[\x22']?\x20{0,2}[=:]\x20{0,2}[\x22']?(?=[A-Za-z+/_.~-]{0,64}[0-9])[A-Za-z0-9+/_.~-]{8,}+",
}
_VALUE = r"[A-Za-z0-9+/_.~-]+$"
_KEYS = ("AKIA", "ASIA", "AROA", "AIDA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "eyJ")
_ASSIGNED = r"(?i)(?:token|secret|password|passwd|pwd|key)[\x22']?\x20{0,2}[=:]"
IP_PART = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$"
# A lone digit run is no word; the look-behind keeps it from being tried at each digit.
WORD = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u9FFF\uF900-\uFAFF]{2}|(?:[\p{L}\p{M}][\p{L}\p{M}\p{N}]|(?<!\p{N})\p{N}++[\p{L}\p{M}])[\p{L}\p{M}\p{N}]*+"

#: Distinct texts that a term must share with an entity.
SUPPORT = 2
GENERALISE, REMOVE = 0.8, 0.95
#: Number and share of a text's distinct words beyond both of which those that tell of one entity tell of copying, and need evidence from other texts.
FEW, COPIED = 5, 0.05
#: Wilson's interval: 1.96 standard errors.
Z = 1.96
#: Code points (at most) of a beginning that may stand for a term.
STEM = 32
#: Rows of a prefix sum worked at once.
BLOCK = 128
#: Code points of a block of text, cut once so that pieces are taken from near.
CUT = 512

SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def _before(sizes: Column, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """What join makes of all values ahead of each (0 ahead of the first): running sums or maxima, in blocks, so in linear time."""
    none = F.array().cast("array<int>")

    def scan(values: Column, first: Column) -> Column:
        step = lambda acc, x: F.struct(join(acc["at"], x).cast("int").alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(values, F.struct(first.cast("int").alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        return _let(blocks, lambda bl: F.flatten(F.zip_with(bl, scan(F.transform(bl, lambda x: F.aggregate(x, F.lit(0), lambda a, y: join(a, y).cast("int"))), F.lit(0)), scan)))

    return _let(sizes, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(none))


def _zipped(text: Column, pattern: str) -> Column:
    """array<struct<gap, hit>>: the matches in order, each after what precedes it; the rest of the text ends it, without a hit."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the matches in order; each offset is the sum of what precedes it."""

    def spans_of(pairs: Column) -> Column:
        size = lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0))
        start = lambda p, at: at + F.length(p["gap"])
        return F.zip_with(pairs, _before(F.transform(pairs, size)), lambda p, at: F.struct(start(p, at).alias("start"), (start(p, at) + F.length(p["hit"])).alias("end"), p["hit"].alias("value")))

    return F.filter(_let(_zipped(text, pattern), spans_of), lambda s: s["value"].isNotNull())


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(IP_PART))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _may_have(kind: str, text: Column) -> Column:
    """A quick look, false where there is no match."""
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    if kind == "secret":
        return reduce(Column.__or__, map(text.contains, _KEYS)) | ((text.contains("=") | text.contains(":")) & text.rlike(_ASSIGNED))
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][\x20-]?[0-9]")


def pattern_spans(text: Column) -> Column:
    """Valid spans of all base kinds and of secrets, by start, then kind."""

    def of(rank: int, kind: str) -> Column:
        kept = F.filter(located(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
        value = (lambda s: F.regexp_extract(s["value"], _VALUE, 0)) if kind == "secret" else (lambda s: s["value"])
        tagged = F.transform(kept, lambda s: F.struct((s["end"] - F.length(value(s))).alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), value(s).alias("value")))
        return F.when(_may_have(kind, text), tagged).otherwise(F.array().cast(SPAN))

    return F.array_sort(F.concat(*[of(rank, kind) for rank, kind in enumerate(KINDS[:TERM])]))


def _class(rank: Column, value: Column) -> Column:
    """What an entity shares with others of its kind; null where there is no such level."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (F.when(rank == 0, F.lower(F.substring_index(value, "@", -1))).when(rank == 1, F.substring_index(value, ".", 2))
            .when(rank == 2, F.substring(digits, 1, 6)).when(rank == 3, F.substring(digits, 1, 4)))


def _hidden(text: Column, kind: str) -> Column:
    """text with e-mail addresses, or the values of secrets, blanked, length kept."""
    shown = (lambda hit: F.regexp_replace(hit, _VALUE, "")) if kind == "secret" else (lambda hit: F.lit(""))
    blank = F.transform(_zipped(text, PATTERNS[kind]), lambda p: F.concat(p["gap"], F.coalesce(F.concat(shown(p["hit"]), F.repeat(F.lit(" "), F.length(p["hit"]) - F.length(shown(p["hit"])))), F.lit(""))))
    return F.when(_may_have(kind, text), F.array_join(blank, "")).otherwise(text)


def _outside(text: Column) -> Column:
    """text with e-mail addresses and secrets blanked, length kept."""
    return _let(_hidden(text, "email"), lambda t: _hidden(t, "secret"))


def _words(text: Column) -> Column:
    """Distinct lower-case words outside e-mail addresses and secrets."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_outside(text)), F.lit(WORD), F.lit(0)))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, th, spans, text) for every row, in one pass over the texts; text: null where there are no spans."""
    text = _text()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).withColumn("spans", pattern_spans(F.col("text")))
    return base.select("doc_id", "th", "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text"))


def copies(found: DataFrame) -> DataFrame:
    """(th, n): texts that n > 1 rows share."""
    return found.groupBy("th").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def frequencies(docs: DataFrame, repeated: DataFrame, of: Column, name: str) -> DataFrame:
    """(name, df): in how many distinct texts each of an array of values stands; repeated: copies().

    A row of a text that n rows share counts 1 / n, so no text need be shuffled
    to count once; the sums are whole numbers.
    """
    text = _text()
    each = docs.select(F.xxhash64(text).alias("th"), text.alias("text")).join(repeated, "th", "left")
    each = each.select((F.lit(1.0) / F.coalesce("n", F.lit(1))).alias("part"), F.explode(of).alias(name))
    return each.groupBy(name).agg(F.round(F.sum("part")).cast("long").alias("df"))


def entities(found: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(th, cls, df_entity, exact, weight): entities of each distinct text, of all three levels.

    Entities that stand in exactly the same texts have the same figures and are
    one cls; exact: a value is among them; weight: 1 by the number of the
    entity's texts that have the same value.  Entities of fewer texts than
    support are left out.
    """
    held = found.where(F.size("spans") > 0).select("th", F.explode("spans").alias("s")).select("th", "s.rank", "s.value").distinct()
    val = F.xxhash64("rank", "value").alias("val")
    level = lambda k, v: F.struct(F.lit(k).alias("level"), F.col("rank").alias("rank"), v.alias("name"))
    node = held.select("th", val, F.explode(F.array(level(0, F.col("value")), level(1, _class(F.col("rank"), F.col("value"))), level(2, F.lit("")))).alias("node")).where("node.name IS NOT NULL")
    node = materialise(node.groupBy("th", "node").agg(F.min("val").alias("val")), "pii-nodes")
    per = node.groupBy("node").agg(F.count(F.lit(1)).alias("df_entity"), F.bit_xor("th").alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "th")).alias("y")).where(F.col("df_entity") >= support)
    # One entity of each class stands for it.
    cls = per.groupBy("df_entity", "x", "y").agg((F.min("node.level") == 0).alias("exact"), F.min("node").alias("node"))
    kept = measured(cls.select("node.level", "node.rank", "node.name", F.xxhash64("df_entity", "x", "y").alias("cls"), "df_entity", "exact"), "pii-classes")
    found_ = node.select("th", "node.level", "node.rank", "node.name", "val").join(kept, ["level", "rank", "name"]).select("th", "cls", "df_entity", "exact", "val")
    # A value that several texts of an entity share counts once among them.
    many = measured(found_.groupBy("cls", "val").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1), "pii-repeats")
    return found_.join(many, ["cls", "val"], "left").select("th", "cls", "df_entity", "exact", (F.lit(1.0) / F.coalesce("m", F.lit(1))).alias("weight"))


def _share(n: Column, both: Column, cases: Column, df_entity: Column, df_term: Column, exact: Column) -> Column:
    """PMI / IC = 1 + log2 P(entity | term) / IC; P by Wilson's lower bound unless exact, from fewer cases than df_term, as cases are to both."""
    info = F.log2(n / df_entity)
    p = both / df_term
    size = df_term * cases / both
    low = (p + Z * Z / (2 * size) - Z * F.sqrt(p * (1 - p) / size + Z * Z / (4 * size * size))) / (1 + Z * Z / size)
    return F.when(info > 0, F.least(F.lit(1.0), 1 + F.log2(F.when(exact, p).otherwise(low)) / info)).otherwise(0.0)


def occurring(found: DataFrame, entity: DataFrame) -> DataFrame:
    """(th, words, entities): each distinct text that has entities, its distinct words, and its entities as array<struct<cls, df_entity, exact, weight>>."""
    of = entity.groupBy("th").agg(F.collect_list(F.struct("cls", "df_entity", "exact", "weight")).alias("entities"))  # entities of one text
    texts = found.where(F.size("spans") > 0).select("th", "text").dropDuplicates(["th"]).join(of, "th")
    return materialise(texts.select("th", _words(F.col("text")).alias("words"), "entities"), "pii-texts")


def _both(held: DataFrame, of: str) -> DataFrame:
    """(cls, term, both, cases, df_entity, exact): distinct texts that an entity and a term of the array column of share, and different values of the entity there; one partial row per task."""
    each = held.select("entities", F.explode(of).alias("term")).select("term", F.explode("entities").alias("e"))
    return each.groupBy("e.cls", "term").agg(F.count(F.lit(1)).alias("both"), F.sum("e.weight").alias("cases"), F.max("e.df_entity").alias("df_entity"), F.max("e.exact").alias("exact"))


def evidence(held: DataFrame, df_term: DataFrame, n: int, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """(cls, term, share) of terms whose disclosure of the entity, among n distinct texts, reaches the threshold; and the counts it comes from."""
    both = _both(held, "words").where(F.col("both") >= support)
    known = both.join(df_term.select("term", F.col("df").alias("df_term")), "term")
    return _telling(known, n, threshold).select("cls", "term", "share", "both", "cases", "df_entity", "df_term", "exact")


def _telling(known: DataFrame, n: int, threshold: float) -> DataFrame:
    share = _share(F.lit(float(max(1, n))), F.col("both"), F.col("cases"), F.col("df_entity"), F.col("df_term"), F.col("exact"))
    return known.withColumn("share", share).where(F.col("share") >= threshold)


def telling_terms(held: DataFrame, df_term: DataFrame, n: int, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """(cls, term, share) of terms whose disclosure of the entity, among n distinct texts, reaches the threshold."""
    return evidence(held, df_term, n, support, threshold).select("cls", "term", "share")


def told_beside_copies(copied: DataFrame, telling: DataFrame, n: int, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """(th, cls, term, share) of what still tells in copied texts (th, cls, t) when all of them that one entity has count as one text."""
    rows = copied.select("th", "cls", F.inline("t")).select("th", "cls", "term")
    texts = copied.groupBy("cls").agg((F.count(F.lit(1)) - 1).alias("fewer"))
    per = rows.groupBy("cls", "term").agg((F.count(F.lit(1)) - 1).alias("less")).join(texts, "cls")
    known = telling.drop("share").join(per, ["cls", "term"]).withColumn("both", F.col("both") - F.col("less")).where(F.col("both") >= support)
    # No more cases than texts.
    known = known.withColumn("cases", F.least("cases", "both")).withColumn("df_term", F.col("df_term") - F.col("less")).withColumn("df_entity", F.col("df_entity") - F.col("fewer"))
    return rows.join(measured(_telling(known, n, threshold).select("cls", "term", "share"), "pii-beside"), ["cls", "term"]).select("th", "cls", "term", "share")


def _marked(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(th, start, end, term, share) of every occurrence of a text's terms (th, term, share)."""
    words = texts.select("th", F.posexplode(_zipped(_outside(F.col("text")), WORD)).alias("no", "p"))
    size = F.coalesce(F.length("p.hit"), F.lit(0))
    words = words.select("th", "no", F.col("p.hit").alias("hit"), (F.length("p.gap") + size).alias("step"), size.alias("size"))
    stop = F.sum("step").over(Window.partitionBy("th").orderBy("no").rowsBetween(Window.unboundedPreceding, 0))  # words of one text
    words = words.withColumn("end", stop.cast("int")).where(F.col("hit").isNotNull())
    return words.select("th", F.lower("hit").alias("term"), (F.col("end") - F.col("size")).alias("start"), "end").join(terms, ["th", "term"]).select("th", "start", "end", "term", "share")


def _work(docs: DataFrame) -> dict:
    """The steps' tables: found, repeated, held, terms (th, term, share, cls); n: the number of distinct texts."""
    found = materialise(find(docs), "pii")
    n = found.select("th").distinct().count()
    repeated = measured(copies(found), "pii-copies")
    held = occurring(found, entities(found))
    df_term = frequencies(docs, repeated, _words(F.col("text")), "term")
    telling = measured(evidence(held, df_term, n), "pii-telling")
    each = held.select("th", F.size("words").alias("of"), "entities.cls", F.explode("words").alias("term")).select("th", "of", "term", F.explode("cls").alias("cls"))
    told = each.join(telling.select("cls", "term", "share"), ["cls", "term"]).groupBy("th", "cls").agg(F.max("of").alias("of"), F.collect_list(F.struct("term", "share")).alias("t"))  # words of one text
    told = materialise(told, "pii-told")
    own = (F.size("t") <= FEW) | (F.size("t") <= COPIED * F.col("of"))
    told = told.where(own).select("th", "cls", F.inline("t")).unionByName(told_beside_copies(told.where(~own), telling, n))
    terms = materialise(told.groupBy("th", "term").agg(F.max(F.struct("share", "cls")).alias("x")).select("th", "term", "x.share", "x.cls"), "pii-terms")
    return {"found": found, "repeated": repeated, "held": held, "terms": terms, "n": n}


def _with_terms(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, th, spans, terms) for every row of found; terms: array<struct<start, end, term, share>> that the method adds."""
    some = terms.select("th").distinct()
    texts = found.where(F.size("spans") > 0).select("th", "text").join(some, "th", "left_semi").dropDuplicates(["th"])
    per = _marked(texts, terms).groupBy("th").agg(F.sort_array(F.collect_list(F.struct("start", "end", "term", "share"))).alias("terms"))  # words of one text
    none = F.array().cast("array<struct<start:int,end:int,term:string,share:double>>")
    # Rows without spans, many of which may share a text, stay out of the join.
    out = found.where(F.size("spans") > 0).join(per, "th", "left").select("doc_id", "th", "spans", F.coalesce("terms", none).alias("terms"))
    return out.unionByName(found.where(F.size("spans") == 0).select("doc_id", "th", "spans", none.alias("terms")))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, th, spans, terms) for every row; terms: array<struct<start, end, term, share>> that the method adds."""
    work = _work(docs)
    return _with_terms(work["found"], work["terms"].select("th", "term", "share"))


def _listed(spans_: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", kind[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(rank: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")


def _base() -> list[Column]:
    """n_email, n_ip, n_card, n_phone and base_sha256 of the column spans."""
    base = F.filter("spans", lambda s: s["rank"] < BASE)
    return [*[_count(r).alias(f"n_{k}") for r, k in enumerate(KINDS[:BASE])], F.sha2(_listed(base), 256).alias("base_sha256")]


def base_report(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256) for every row of find()."""
    return found.select("doc_id", *_base())


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_terms, n_spans) for every row."""
    added = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(TERM).alias("rank"), t["end"].alias("end"), F.lit("").alias("value")))
    return spans(docs).select(
        "doc_id", *_base(), _listed(F.array_sort(F.concat("spans", added))).alias("spans"),
        _count(SECRET).alias("n_secret"), F.size("terms").cast("long").alias("n_terms"), (F.size("spans") + F.size("terms")).cast("long").alias("n_spans"))


def stems(docs: DataFrame, work: dict) -> DataFrame:
    """(cls, term, stem): the beginning, half the word, that may stand for a term as it reveals less than GENERALISE of the entity."""
    half = F.expr("int(floor((length(term) + 1) / 2))")
    terms = work["terms"].where(F.col("share") < REMOVE).select("cls", "term").distinct()
    wanted = materialise(terms.withColumn("stem", F.expr("substring(term, 1, int(floor((length(term) + 1) / 2)))")).where((F.length("term") >= 4) & (half <= STEM)), "pii-stems")
    stem = measured(wanted.select("stem").distinct(), "pii-beginnings")
    begins = lambda words: F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.length(w), F.lit(STEM)))), lambda k: F.substring(w, F.lit(1), k)))))
    df_stem = frequencies(docs, work["repeated"], begins(_words(F.col("text"))), "term").join(stem.withColumnRenamed("stem", "term"), "term", "left_semi")
    both = _both(work["held"].select("entities", begins(F.col("words")).alias("words")), "words").join(stem.withColumnRenamed("stem", "term"), "term", "left_semi")
    known = both.join(df_stem.select("term", F.col("df").alias("df_term")), "term")
    share = _share(F.lit(float(max(1, work["n"]))), F.col("both"), F.col("cases"), F.col("df_entity"), F.col("df_term"), F.col("exact"))
    return wanted.join(known.where(share < GENERALISE).select("cls", F.col("term").alias("stem")), ["cls", "stem"]).select("cls", "term", "stem")


def _spliced(text: Column, cuts: Column) -> Column:
    """text with cuts (array<struct<start, rank, end, value>>, sorted) replaced by their values; what overlaps an earlier cut only extends it."""

    def of(blocks: Column, some: Column) -> Column:
        """Blocks hold CUT code points each."""

        def piece(a: Column, b: Column) -> Column:
            first, last = F.floor(a / CUT).cast("int"), F.floor(b / CUT).cast("int")
            start, stop = F.get(blocks, first), F.get(blocks, last)
            inside = F.substring(start, a - first * CUT + 1, b - a)
            wide = F.concat(F.substring(start, a - first * CUT + 1, F.lit(CUT)), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.coalesce(F.substring(stop, F.lit(1), b - last * CUT), F.lit("")))
            return F.when(b <= a, F.lit("")).when(first == last, inside).otherwise(wide)

        ends = _before(F.transform(some, lambda c: c["end"]), F.greatest)
        parts = F.zip_with(some, ends, lambda c, at: F.when(c["start"] < at, F.lit("")).otherwise(F.concat(piece(at, c["start"]), c["value"])))
        last = F.aggregate(some, F.lit(0), lambda a, c: F.greatest(a, c["end"]))
        return _let(last, lambda at: F.concat(F.array_join(parts, ""), piece(at, F.length(text))))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    return F.when(F.size(cuts) > 0, _let(blocks, lambda b: _let(cuts, lambda c: of(b, c)))).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with base spans and secrets masked by kind, telling terms cut to a beginning that tells little, masked as [TERM] or removed; overlaps mask once."""
    work = _work(docs)
    terms = materialise(work["terms"].join(stems(docs, work), ["cls", "term"], "left"), "pii-ladder")
    d, t, s_, m = unused(docs, "doc", "th", "spans", "terms")
    mask = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    # The word's own case is lost with a beginning; the rest of the word is an ellipsis.
    put = F.when(F.col("share") >= REMOVE, F.lit("")).otherwise(F.coalesce(F.concat("stem", F.lit("\u2026")), mask[TERM]))
    named = terms.select("th", "term", "share", put.alias("put"))
    texts = work["found"].where(F.size("spans") > 0).select("th", "text").join(named.select("th").distinct(), "th", "left_semi").dropDuplicates(["th"])
    marked = _marked(texts, named.select("th", "term", "share")).join(named.select("th", "term", "put"), ["th", "term"])
    per = marked.groupBy("th").agg(F.collect_list(F.struct("start", F.lit(TERM).alias("rank"), "end", F.col("put").alias("value"))).alias(m))  # words of one text
    held = work["found"].where(F.size("spans") > 0).select("doc_id", "th", "spans").dropDuplicates(["doc_id", "th"])
    held = held.join(per, "th", "left").select(F.col("doc_id").alias(d), F.col("th").alias(t), F.col("spans").alias(s_), m)
    text = _text()
    base = F.transform(F.col(s_), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), mask[s["rank"]].alias("value")))
    cuts = F.array_sort(F.concat(base, F.coalesce(F.col(m), F.array().cast(SPAN))))
    joined = docs.join(held, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(t)), "left")
    masked = F.when(F.col("text").isNotNull() & F.col(s_).isNotNull(), _spliced(text, cuts)).otherwise(F.col("text"))
    return joined.select(*[masked.alias("text") if c == "text" else F.col(quoted(c)) for c in docs.columns])
