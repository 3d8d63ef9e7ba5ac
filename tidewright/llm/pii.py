r"""Personal data and what reveals it (operator 7), in DataFrame functions only.

Base spans are found by pattern: e-mail addresses, IP addresses (parts at most 255), card numbers (13 to 19
digits, Luhn) and phone numbers (9 to 15 digits), leftmost and non-overlapping per kind.

Information-theoretic sanitisation adds spans of kind ``term``.  Contexts are lines, and documents.  Over the whole corpus, the
number of contexts with entity e (the text of a base span), with word t (three letters or more, lower case) and with
both give the pointwise mutual information; divided by the information of e it is the share of e that t discloses:

    disclosure(e, t) = ln(N c(e,t) / (c(e) c(t))) / ln(N / c(e)) = 1 - ln(1 / P(e|t)) / ln(N / c(e))

It is 1 if t occurs beside e only.  P(e|t) is taken at the lower end of its confidence interval (Wilson, one-sided, ``Z``)
by the number of different contexts that hold both: copies of a line or text count once there, and
one context tells nothing.  Words whose disclosure is ``threshold`` or more, among lines or among documents, are
spans wherever they occur in a document that names e.  In the sanitised text, base spans are generalised to
their kind and terms are removed.

Entities that stand in the same contexts disclose alike and are counted as one class; entities of a single context aren't
counted at all; words too frequent to disclose any entity of their context are left out before pairs are made.  So a
page that lists many addresses doesn't make all pairs of addresses and words.  Offsets within a text come from
running sums in blocks, which take time in proportion to the text, nearly.

Results: null and empty texts have no spans; offsets are code points, end exclusive; rows are judged one by one,
repeated ones alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import cut, sifted
from tidewright.llm.fingerprint import let

KINDS = ("email", "ip", "card", "phone", "term")
#: The patterns of the contract, written so that no start is tried in vain: a match that fails at the first character of
#: a run of its first class fails at the others too.  The card pattern takes maximal chains of digits of the right length only.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What every match contains, to skip the pattern where it is missing.
_HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
SPAN = "struct<kind:int,start:int,end:int,value:string>"
WORD = r"\p{L}{3,}"
THRESHOLD = 0.9
Z = 1.645  # 95 % of confidence
BLOCK = 256  # array elements that one running sum copies
PIECE = 4096  # characters


def _valid(kind: str, value: Column) -> Column:
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: F.when(F.length(part(p)) <= 3, part(p).cast("int") <= 255).otherwise(False))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    doubled = lambda d, i: F.when((i % 2) == 0, d).when(d < 5, d * 2).otherwise(d * 2 - 9)
    luhn = F.aggregate(F.transform(F.split(F.reverse(digits(value)), ""), lambda c, i: doubled(c.cast("int"), i)), F.lit(0), lambda a, x: a + x)
    return luhn % 10 == 0


def _check(kind: str):
    return lambda span: _valid(kind, span["value"])


def before(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each number of an array, what ``merge`` makes of those before it, from 0; in blocks, because an array that grows is copied."""
    none = F.array().cast("array<int>")

    def prefix(block: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), none.alias("out"))
        return F.aggregate(block, zero, lambda acc, x: F.struct(merge(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: merge(acc, x).cast("int")))
        return let(prefix(totals, F.lit(0)), lambda base: F.flatten(F.zip_with(blocks, base, prefix)))

    cut_up = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda i: F.slice(v, i * BLOCK + 1, F.lit(BLOCK)))
    return let(values, lambda v: F.when(F.size(v) > 0, let(cut_up(v), joined)).otherwise(none))


def placed(items: Column, kind: int) -> Column:
    """Spans of an array of ``(gap, value)``, where the gap is the number of characters since the one before."""
    ends = lambda xs: before(F.transform(xs, lambda x: x["gap"] + F.length(x["value"])), lambda a, x: a + x)
    span = lambda x, at: F.struct(F.lit(kind).alias("kind"), (at + x["gap"]).alias("start"), (at + x["gap"] + F.length(x["value"])).alias("end"), x["value"].alias("value"))
    return let(items, lambda xs: F.zip_with(xs, ends(xs), span))


def _parts(text: Column, pattern: str) -> Column:
    """``(gap, value)`` of all matches, and a last gap with a null value."""
    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda a, b: F.struct(a.alias("gap"), b.alias("value")))


def located(text: Column, pattern: str, kind: int) -> Column:
    """All matches with their places: what lies between them gives the offsets."""
    hits = F.filter(_parts(text, pattern), lambda x: x["value"].isNotNull())
    return placed(F.transform(hits, lambda x: F.struct(F.length(x["gap"]).alias("gap"), x["value"].alias("value"))), kind)


def base_spans(text: Column) -> Column:
    """The spans of all base kinds, by kind and start."""
    none = F.array().cast(f"array<{SPAN}>")
    found = []
    for i, kind in enumerate(KINDS[:4]):
        hit = F.contains(text, F.lit(_HINT[kind])) if _HINT[kind] else F.lit(True)
        found.append(F.when(hit & text.rlike(PATTERNS[kind]), F.filter(located(text, PATTERNS[kind], i), _check(kind))).otherwise(none))
    return F.concat(*found)


def lines_of(text: Column) -> Column:
    """The lines as spans."""
    return placed(F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.when(i == 0, 0).otherwise(1).alias("gap"), x.alias("value"))), 0)


def masked(line: Column) -> Column:
    """A line whose addresses are blanked; the other kinds of spans have no letters."""
    blank = lambda x: F.concat(x["gap"], F.repeat(F.lit("\u0001"), F.coalesce(F.length(x["value"]), F.lit(0))))
    return F.when(F.contains(line, F.lit("@")), F.array_join(F.transform(_parts(line, PATTERNS["email"]), blank), "")).otherwise(line)


def words(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0)))


def frequencies(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``w, in_lines, in_docs``: in how many lines and documents of the corpus each wanted word stands."""
    lines = lambda t: F.flatten(F.transform(F.split(t, "\n"), words))
    once = lambda xs, g: F.transform(xs, lambda x: F.struct(x.alias("term"), F.lit(g).alias("g")))
    each = texts.select(F.explode(let(lines(F.col("text")), lambda xs: F.concat(once(xs, 0), once(F.array_distinct(xs), 1)))).alias("x")).select("x.term", "x.g")
    sought = wanted.select(F.col("term").alias("w"), F.xxhash64("term").alias("w_hash"))
    passed = sifted(each.withColumn("hash", F.xxhash64("term")), "hash", sought, "w_hash")
    counted = passed.groupBy("term").agg(F.count_if(F.col("g") == 0).alias("in_lines"), F.count_if(F.col("g") == 1).alias("in_docs"))
    return counted.join(sought, F.col("term") == F.col("w")).select("w", "in_lines", "in_docs")


def disclosures(lines: DataFrame, texts: DataFrame, n_lines: int, n_docs: int, threshold: float) -> DataFrame:
    """``key, term``: the words that disclose an entity of a document; ``lines``: key, copies, at, line, entities."""
    named = lines.where(F.size("entities") > 0).withColumn("context", F.xxhash64("line"))
    beside = named.select(F.lit(0).alias("g"), "context", "copies", F.explode("entities").alias("entity")).groupBy("g", "context", "entity").agg(F.sum("copies").alias("m"))
    within = named.select(F.lit(1).alias("g"), F.col("key").alias("context"), "copies", F.explode("entities").alias("entity")).groupBy("g", "context", "entity").agg(F.max("copies").alias("m"))
    stands = cut(beside.unionByName(within))
    entities = stands.groupBy("g", "entity").agg(F.sum("m").alias("c_e"), F.count(F.lit(1)).alias("different"), F.bit_xor(F.xxhash64("context")).alias("sign")).where("different > 1")
    n = F.when(F.col("g") == 0, F.lit(float(n_lines))).otherwise(F.lit(float(n_docs)))
    entities = entities.select("g", "entity", "c_e", F.xxhash64("g", "c_e", "different", "sign").alias("class"),
        (F.col("c_e") * F.pow(n / F.col("c_e"), 1 - threshold)).alias("most")).where(F.col("c_e") < n)
    kept = entities.withColumnsRenamed({"g": "e_g", "entity": "e_entity"})
    classes = cut(stands.join(kept, (F.col("g") == F.col("e_g")) & (F.col("entity") == F.col("e_entity"))).select("g", "context", "m", "class", "c_e", "most").distinct())
    # the words of these contexts that are rare enough
    open_contexts = classes.groupBy(F.col("g").alias("o_g"), F.col("context").alias("o_context")).agg(F.max("most").alias("most"))
    spoken = named.select(F.lit(0).alias("g"), "context", "line").unionByName(lines.select(F.lit(1).alias("g"), F.col("key").alias("context"), "line"))
    spoken = spoken.join(open_contexts, (F.col("g") == F.col("o_g")) & (F.col("context") == F.col("o_context")))
    terms = cut(spoken.select("g", "context", "most", F.explode(words(masked(F.col("line")))).alias("term")).distinct())
    counts = cut(frequencies(texts, terms.select("term").distinct()))
    c_t = F.when(F.col("g") == 0, F.col("in_lines")).otherwise(F.col("in_docs"))
    rare = terms.join(counts, F.col("term") == F.col("w")).withColumn("c_t", c_t).where(F.col("c_t") <= F.col("most")).select(F.col("g").alias("t_g"),
        F.col("context").alias("t_context"), "term", "c_t")
    both = classes.join(rare, (F.col("g") == F.col("t_g")) & (F.col("context") == F.col("t_context"))).groupBy("g", "class", "c_e", "term",
        "c_t").agg(F.sum("m").alias("c_et"), F.count(F.lit(1)).alias("different")).where("different > 1")
    p = F.least(F.lit(1.0), F.col("c_et") / F.col("c_t"))
    size = F.col("different") / p
    low = (p + Z**2 / (2 * size) - Z * F.sqrt(F.greatest(F.lit(0.0), p * (1 - p)) / size + Z**2 / (4 * size**2))) / (1 + Z**2 / size)
    share = 1 + F.log(low) / F.log(n / F.col("c_e"))
    told = both.where(share >= threshold).select(F.col("g").alias("t_g"), F.col("class").alias("t_class"), "term")
    names = named.select("key", F.explode("entities").alias("entity")).distinct().join(entities, "entity").select("key", "g", "class").distinct()
    return names.join(told, (F.col("g") == F.col("t_g")) & (F.col("class") == F.col("t_class"))).select("key", "term").distinct()


def analyse(docs: DataFrame, threshold: float = THRESHOLD, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``doc_id, base, terms`` (arrays of spans), and ``text`` if asked for."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    base = texts.withColumn("base", base_spans(F.col("text")))
    # everything that follows needs the texts of documents with an entity only
    kept = F.col("text") if keep_text else F.when(F.size("base") > 0, F.col("text"))
    found = cut(base.select("doc_id", "base", kept.alias("text"), F.size(F.split("text", "\n")).alias("n_lines"), F.xxhash64("text").alias("key")))
    n_lines, n_docs = found.agg(F.coalesce(F.sum("n_lines"), F.lit(0)), F.count(F.lit(1))).first()
    named = found.where(F.size("base") > 0)
    each = named.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")).select("key", "copies",
        F.explode(lines_of(F.col("text"))).alias("x")).select("key", "copies", F.col("x.start").alias("at"), F.col("x.value").alias("line"))
    entities = F.array_distinct(F.transform(base_spans(F.col("line")), lambda s: F.concat_ws(":", s["kind"].cast("string"), F.lower(s["value"]))))
    lines = cut(each.withColumn("entities", entities))
    reveal = cut(disclosures(lines, texts, n_lines, n_docs, threshold))
    told = reveal.select(F.col("key").alias("r_key"), F.col("term").alias("r_term"))
    hits = lines.join(told.select("r_key").distinct(), F.col("key") == F.col("r_key"), "left_semi").select("key", "at", F.explode(located(masked(F.col("line")), WORD, 4)).alias("s"))
    hits = hits.join(told, (F.col("key") == F.col("r_key")) & (F.lower("s.value") == F.col("r_term"))).select("key",
        F.struct("s.kind", (F.col("s.start") + F.col("at")).alias("start"), (F.col("s.end") + F.col("at")).alias("end"), "s.value").alias("s"))
    terms = hits.groupBy(F.col("key").alias("k_key")).agg(F.array_sort(F.collect_list("s")).alias("terms"))
    none = F.array().cast(f"array<{SPAN}>")
    columns = ["doc_id", "base", "terms", *(["text"] if keep_text else [])]
    with_terms = named.join(terms, F.col("key") == F.col("k_key"), "left").withColumn("terms", F.coalesce("terms", none)).select(*columns)
    return found.where(F.size("base") == 0).withColumn("terms", none).select(*columns).unionByName(with_terms)


def joined_spans(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, threshold: float = THRESHOLD, **names) -> DataFrame:
    """``doc_id, text, spans``: base spans generalised to ``[kind]``, terms removed; spans that overlap go together, by the kind of the first."""
    rows = analyse(docs, threshold, keep_text=True, **names)
    spans = F.array_sort(F.transform(F.concat("base", "terms"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    label = F.array(*[F.lit(f"[{k}]") for k in KINDS[:4]], F.lit(""))
    reach = before(F.transform("all", lambda s: s["end"]), lambda a, x: F.greatest(a, x))
    # the first span of each group, and up to where the groups before it reach
    lead = F.filter(F.zip_with("all", "reach", lambda s, r: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), r.alias("past"))), lambda x: x["start"] >= x["past"])
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def piece(begin: Column, end: Column) -> Column:
        first = F.floor(begin / PIECE).cast("int")
        held = F.slice("blocks", first + 1, F.floor((end - 1) / PIECE).cast("int") - first + 1)
        return F.when(end > begin, F.array_join(held, "").substr(begin - first * PIECE + 1, end - begin)).otherwise("")

    head = F.array_join(F.transform("lead", lambda x: F.concat(piece(x["past"], x["start"]), label[x["kind"]])), "")
    last = F.greatest(F.lit(0), F.array_max(F.transform("all", lambda s: s["end"])))
    whole = F.when(F.size("all") == 0, F.col("text")).otherwise(F.concat(head, piece(last, F.char_length("text"))))
    made = rows.withColumn("all", spans).withColumn("reach", reach).withColumn("lead", lead).withColumn("blocks", blocks)
    return made.select("doc_id", whole.alias("text"), joined_spans(F.concat("base", "terms")).alias("spans"))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    rows = analyse(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return rows.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.size("terms").cast("long").alias("n_term"), (F.size("base") + F.size("terms")).cast("long").alias("n_spans"),
        F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.concat("base", "terms")).alias("spans"),
    )
