"""Personal data: patterns, and terms that give the people behind them away.
DataFrame functions only.

Base spans: e-mail addresses, IP addresses, card and phone numbers, the leftmost
non-overlapping matches of each kind that pass its test.  Each kind's matches and the
gaps between them come from one pattern; running sums of their lengths are the places.

Information-theoretic sanitisation: the values found are the *protected entities*.  A
term near an entity (one of ``WIDTH`` words on either side, up to the next value of the
same kind) may say who is meant.  With ``n`` occurrences of the entity, ``N`` words in
the corpus, ``n_t`` occurrences of the term and ``n_te`` of them near the entity, the
entity's information is ``ln(N / n)`` and the term reveals the share::

    PMI / information = 1 - ln(n_t / n_te) / ln(N / n)

1: the term stands only with this entity; 0: it stands there by chance.  Terms of at
least ``SHARE``, seen in ``SUPPORT`` or more contexts of the entity, disclose it.  Copies
of a context count once, and so do all contexts that repeat each other (near copies): a
context counts by itself when a quarter of its words stand in no other one of the entity.  A disclosing term is *generalised* to its
first ``STEM`` characters when the stem's own share is lower, otherwise *removed*; in
every text, whether or not the entity itself stands there.

All counts cover the whole corpus.  Words are added up map side before they travel, a
context list is linear in the number of values found, and what is broadcast is the
table of disclosing terms while it is smaller than ``SMALL`` bytes (beyond, Spark joins
by shuffle).  Matching is linear in the text: possessive patterns that can only start
where a run starts, or where the last match ended.

Defined results: null text counts as empty, without spans.  Base spans of different
kinds may overlap; added spans never overlap base ones.  Rows that repeat a document
are marked alike.  Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrix.llm.text import stash

WIDTH, SUPPORT, SHARE, STEM, SMALL = 8, 3, 0.9, 3, 32 << 20
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "generalised", "removed")
#: The contract's patterns; possessive, and begun only at a run's start or after a match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold before its pattern is tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"[\p{L}\p{N}]++"
LEAST = 3
SPANS = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"
BLOCK = 256


def add(a: Column, b: Column) -> Column:
    return a + b


def running(steps: str, with_: Callable = add) -> Column:
    """Running sums (or maxima) of a column of longs, 0 or more, in blocks so that a list
    of n costs n * BLOCK."""
    def grow(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(with_(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)), x)))

    none = F.array().cast("array<bigint>")
    return F.when(F.size(steps) == 0, F.array(none)).otherwise(F.transform(
        F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice(F.col(steps), b * BLOCK + 1, F.lit(BLOCK)), none, grow)))


def joined(blocks: str, with_: Callable = add) -> Column:
    """The blocks of ``running`` as one list."""
    before = F.aggregate(F.col(blocks), F.array(F.lit(0).cast("bigint")), lambda acc, b: F.concat(
        acc, F.array(with_(F.get(acc, F.size(acc) - 1), F.coalesce(F.get(b, F.size(b) - 1), F.lit(0))))))
    return F.flatten(F.zip_with(F.col(blocks), F.slice(before, F.lit(1), F.size(blocks)),
                                lambda b, o: F.transform(b, lambda x: with_(x, o))))


def located(df: DataFrame, name: str, pattern: str, when: Column) -> DataFrame:
    """Add ``{name}`` (matches of ``text``), ``{name}_gaps`` (what lies around them) and
    ``{name}_starts`` (their places in characters).

    Lambdas use their arguments only: a column that they named could be computed anew
    for every element.  ``running`` uses its list more than once, so that it is kept."""
    found, gaps, steps, blocks, starts = name, *(f"{name}_{x}" for x in ("gaps", "steps", "blocks", "starts"))
    empty = F.array().cast("array<string>")
    df = df.withColumn(found, F.when(when, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(empty))
    df = df.withColumn(gaps, F.when(F.size(found) > 0, F.split("text", pattern, -1)).otherwise(empty))
    before = F.concat(F.array(F.lit("")), F.slice(found, F.lit(1), F.size(found) - 1))
    df = df.withColumn(steps, F.when(F.size(found) > 0, F.zip_with(
        F.slice(gaps, F.lit(1), F.size(found)), before, lambda g, m: (F.length(g) + F.length(m)).cast("bigint"))).otherwise(
            F.array().cast("array<bigint>")))
    return df.withColumn(blocks, running(steps)).withColumn(starts, joined(blocks)).drop(steps, blocks)


def digits(m: Column) -> Column:
    return F.translate(m, " +-.()", "")


def passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(short(p)) <= 3) & (
            F.coalesce(F.substring(short(p), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits(m)).between(12, 19) & F.call_function("luhn_check", digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


def entity(kind: str, m: Column) -> Column:
    """One spelling of a value."""
    return F.concat(F.lit(f"{kind}:"), digits(m) if kind in ("card", "phone") else F.lower(m))


def terms(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower), lambda t: F.length(t) >= LEAST)


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def with_base(df: DataFrame, kind: str) -> tuple[DataFrame, Column, Column]:
    """``text`` searched for one kind: its spans, and the words around each."""
    need = F.lit(True) if NEEDS[kind] is None else F.contains("text", F.lit(NEEDS[kind]))
    if kind in ("ip", "card"):  # both need two digits close together
        need = need & F.col("text").rlike(r"[0-9][.\x20-]?[0-9]")
    df = located(df, kind, PATTERNS[kind], need)
    found, starts, gaps, good = (F.col(f"{kind}{x}") for x in ("", "_starts", "_gaps", "_good"))
    near = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.slice(gaps, F.lit(2), F.size(found)),
                      lambda b, a: F.struct(b.alias("before"), a.alias("after")))
    placed = F.zip_with(found, starts, lambda m, s: F.struct(s.alias("start"), m.alias("value")))
    df = df.withColumn(f"{kind}_good", F.filter(F.zip_with(placed, near, lambda p, n: F.struct(
        p["start"].alias("start"), p["value"].alias("value"), n["before"].alias("before"), n["after"].alias("after"))),
        lambda s: passes(kind, s["value"])))
    spans = F.transform(good, lambda s: F.struct(
        s["start"].alias("start"), F.lit(BASE.index(kind)).alias("kind"), (s["start"] + F.length(s["value"])).alias("end"),
        s["value"].alias("value")))
    around = F.transform(good, lambda s: F.struct(
        entity(kind, s["value"]).alias("entity"),
        F.reverse(F.slice(F.reverse(terms(s["before"])), 1, WIDTH)).alias("before"),
        F.slice(terms(s["after"]), 1, WIDTH).alias("after")))
    return df, spans, around


def base_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, key, spans, contexts``: base spans by place, and the words around each
    value, for every row; ``key`` stands for the text."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans, around = [], []
    for kind in BASE:
        df, s, c = with_base(df, kind)
        spans.append(s)
        around.append(c)
    return df.select("doc_id", text_key(F.col("text")).alias("key"),
                     F.sort_array(F.concat(*spans)).cast(SPANS).alias("spans"), F.concat(*around).alias("contexts"))


def disclosing(docs: DataFrame, found: DataFrame, support: int = SUPPORT, share: float = SHARE,
               stem: int = STEM) -> DataFrame:
    """``term, kind, share, stem_share`` of every term that discloses an entity (its
    largest share); ``found`` comes from ``base_spans``."""
    contexts = stash(found.select(F.explode("contexts").alias("c")).groupBy("c.entity", "c.before", "c.after")
                     .agg(F.count("*").alias("n")).select("entity", "n", F.array_distinct(F.concat("before", "after")).alias("words"))
                     .withColumn("id", F.monotonically_increasing_id()), "contexts")
    once = (contexts.select("entity", "id", F.explode("words").alias("term")).groupBy("entity", "term")
            .agg(F.count("*").alias("n"), F.first("id").alias("id")).where("n = 1").groupBy("entity", "id").agg(F.count("*").alias("own")))
    apart = contexts.join(once, ["entity", "id"], "left").withColumn("apart", (4 * F.coalesce("own", F.lit(0)) >= F.size("words")).cast("int"))
    near = (apart.select("entity", "n", "apart", F.explode("words").alias("term")).groupBy("entity", "term")
            .agg(F.sum("n").alias("n_te"), (F.sum("apart") + F.max(1 - F.col("apart"))).alias("contexts")))
    near = stash(near, "near")
    entities = contexts.groupBy("entity").agg(F.sum("n").alias("n_e"))
    words = stash(docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term"))
                  .groupBy("term").agg(F.count("*").alias("n_t")), "words")
    total = words.agg(F.sum("n_t")).first()[0] or 0  # one number

    def reveals(n_te: str, n_t: str) -> Column:
        """Capped at 1: a word may stand near two occurrences of one value."""
        information = F.log(F.lit(float(total)) / F.col("n_e"))
        return F.when(information > 0, 1 - F.log(F.greatest(F.lit(1.0), F.col(n_t) / F.col(n_te))) / information)

    close = near.where(F.col("contexts") >= support)
    strong = (close.join(words, "term").join(entities, "entity").withColumn("share", reveals("n_te", "n_t"))
              .where(F.col("share") >= share).withColumn("stem", F.substring("term", 1, stem)))
    stems = near.groupBy("entity", F.substring("term", 1, stem).alias("stem")).agg(F.sum("n_te").alias("n_se"))
    all_stems = words.groupBy(F.substring("term", 1, stem).alias("stem")).agg(F.sum("n_t").alias("n_s"))
    # stems of at least ``support`` contexts only: those of the strong terms
    judged = (strong.join(stems, ["entity", "stem"]).join(all_stems, "stem")
              .withColumn("stem_share", reveals("n_se", "n_s")))
    gone = F.max((F.col("stem_share") >= share) | (F.length("term") <= stem))
    return judged.groupBy("term").agg(F.max("share").alias("share"), F.max("stem_share").alias("stem_share"),
                                      F.when(gone, F.lit(KINDS.index("removed"))).otherwise(
                                          F.lit(KINDS.index("generalised"))).alias("kind"))


def term_spans(docs: DataFrame, found: DataFrame, marked: DataFrame) -> DataFrame:
    """``key, more``: spans of the marked terms in every text that holds one, but for
    those that overlap a base span."""
    size = marked.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    table = marked.select("term", "kind")
    table = F.broadcast(table) if size <= SMALL else table
    text = F.coalesce("text", F.lit(""))
    held = (docs.select(text.alias("text"), F.explode(F.array_distinct(terms(text))).alias("term")).join(table, "term")
            .groupBy("text").agg(F.collect_set("term").alias("marked")))
    df = located(held, "word", TERM, F.lit(True)).withColumn("key", text_key(F.col("text")))
    placed = F.filter(F.zip_with("word", "word_starts", lambda w, s: F.struct(F.lower(w).alias("term"), s.alias("start"), w.alias("value"))),
                      lambda x: F.array_contains("marked", x["term"]))
    words = df.select("key", F.explode(placed).alias("x")).select(
        "key", "x.term", "x.start", (F.col("x.start") + F.length("x.value")).alias("end"), "x.value")
    added = words.join(table, "term").select("key", "start", "kind", "end", "value")
    base = (found.join(added.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("spans").alias("spans"))
            .select("key", F.explode("spans").alias("s")).select("key", "s.*"))
    is_base = F.col("kind") < len(BASE)
    order = Window.partitionBy("key").orderBy("start", "kind", "end")
    past, next_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    free = (added.unionByName(base)
            .withColumn("until", F.max(F.when(is_base, F.col("end"))).over(past))
            .withColumn("from", F.min(F.when(is_base, F.col("start"))).over(next_))
            .where(~is_base & (F.coalesce("until", F.lit(0)) <= F.col("start")) & (F.coalesce("from", F.col("end")) >= F.col("end"))))
    return free.groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end", "value")).cast(SPANS).alias("more"))


def personal_data(docs: DataFrame, **settings) -> tuple[DataFrame, DataFrame]:
    """``(rows, terms)``: ``doc_id, key, base, spans`` of every row (spans: start, kind as
    an index of ``KINDS``, end, value; by place) and the table of ``disclosing`` terms,
    whose settings are passed on."""
    found = stash(base_spans(docs), "base")
    marked = stash(disclosing(docs, found, **settings), "terms")
    more = term_spans(docs, found, marked)
    rows = found.select("doc_id", "key", F.col("spans").alias("base")).join(more, "key", "left")
    return rows.select("doc_id", "key", "base", F.sort_array(
        F.concat("base", F.coalesce("more", F.array().cast(SPANS)))).alias("spans")), marked


def listed(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, stem: int = STEM, **settings) -> DataFrame:
    """``doc_id, text, sanitised``: values replaced by ``[kind]``, generalised terms by
    their stem and ``*``, removed ones by ``[...]``."""
    rows, _ = personal_data(docs, stem=stem, **settings)
    spans = rows.groupBy("key").agg(F.first("spans").alias("spans"))  # equal texts have equal spans
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    df = df.join(spans.where(F.size("spans") > 0), "key", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))
    # the text in pieces of 1000 characters, so that a span is cut from its own pieces
    df = df.withColumn("_pieces", F.regexp_extract_all("text", F.lit("(?s).{1,1000}"), F.lit(0)))
    df = df.withColumn("_ends", F.transform("spans", lambda s: s["end"])).withColumn("_blocks", running("_ends", F.greatest))
    df = df.withColumn("_past", F.concat(F.array(F.lit(0).cast("bigint")), joined("_blocks", F.greatest)))  # end of what is covered

    def cut(a: Column, b: Column) -> Column:
        first = F.floor(a / 1000).cast("int")
        some = F.array_join(F.slice(F.col("_pieces"), first + 1, F.floor(b / 1000).cast("int") - first + 1), "")
        return F.when(b > a, F.substr(some, (a % 1000 + 1).cast("int"), (b - a).cast("int"))).otherwise(F.lit(""))

    tags = F.array(*[F.lit(f"[{k}]") for k in BASE])
    parts = F.transform("spans", lambda s, i: F.concat(cut(F.get(F.col("_past"), i), s["start"]), F.coalesce(
        F.get(tags, s["kind"]), F.when(s["kind"] == KINDS.index("generalised"), F.concat(F.substring(s["value"], 1, stem), F.lit("*"))),
        F.lit("[...]"))))
    last = cut(F.element_at("_past", -1), F.length("text").cast("bigint"))
    return df.select("doc_id", "text", F.concat(F.array_join(parts, ""), last).alias("sanitised"))
