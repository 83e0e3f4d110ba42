"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Patterns find what to protect (email, ip, card, phone). An entity is such a
value, and what it shares with its like: the user and the domain of an address,
the network of an ip, the exchange of a phone number. So entities recur even
where values do not. The method
then asks the corpus which other terms give an entity away. With n documents,
a term t and an entity e, the pointwise mutual information

    PMI(t, e) = ln(n * n(t, e) / (n(t) * n(e)))

is compared with what there is to disclose, IC(e) = ln(n / n(e)); a term whose
PMI reaches DISCLOSURE of that, seen with the entity in at least SUPPORT
different contexts, discloses it. In the documents that hold the entity such
terms become spans of their own.

A context is the CONTEXT words on either side of e; it only proposes terms.
n(t, e) counts the documents that hold both, wherever in the text, n(t) and
n(e) those with the term and with the entity, and a disclosing term is
searched in the whole text of every document that holds its entity. Terms are
counted over the corpus, combined before the shuffle, and joined with those
that pass SUPPORT. Texts move only in the last join, and only if the
documents with disclosing terms are too many to broadcast (Spark checks).

A match's offsets come from the lengths of the pieces around it, so they are
code points. The patterns are written so that each text is scanned once:
matches start where a run of their characters starts (or the last match
ended), which leaves the leftmost matches as they are. Spans are worked through
in blocks of BLOCK with a piece of the text each, so that a text of a hundred
thousand matches takes seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored

KINDS = ("email", "ip", "card", "phone", "term")
#: Share of an entity's information that a term may give away; contexts needed; words of context on a side.
DISCLOSURE, SUPPORT, CONTEXT = 0.9, 3, 6

LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a kind cannot occur, to skip texts cheaply.
NEEDS = {"email": "@", "phone": "+"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
#: Spans of a block.
BLOCK = 256


def _luhn(digits: Column) -> Column:
    d = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    twice = lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(d, twice), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _checker(kind: str):
    return lambda s: _valid(kind, s["value"])


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(items: str) -> Column:
    """Column items cut into arrays of BLOCK; empty: none."""
    n = F.size(items)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(items, i + 1, BLOCK))).otherwise(F.slice(F.array(F.col(items)), 1, 0))


def _carried(blocks: str, step) -> Column:
    """For each block, what step(value so far, block) has made of 0 before it."""
    return F.aggregate(
        blocks, F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<int>)").alias("out")),
        lambda a, b: F.struct(step(a["at"], b).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])


def _located(blocks: str, kind: int) -> Column:
    """Matches with their offsets in code points, by running sums over the pieces between them; blocks of (gap, value)."""
    after = lambda at, x: at + F.length(x["gap"]) + F.length(x["value"])
    starts = _carried(blocks, lambda at, b: F.aggregate(b, at, after))
    within = lambda b, s: F.aggregate(
        b, F.struct(s.alias("at"), F.expr(f"CAST(array() AS {SPAN})").alias("out")),
        lambda a, x: F.struct(after(a["at"], x).alias("at"), F.array_append(a["out"], F.struct((a["at"] + F.length(x["gap"])).alias("start"), F.lit(kind).alias("kind"), after(a["at"], x).alias("end"), x["value"].alias("value"))).alias("out")),
        lambda a: a["out"])
    return F.flatten(F.zip_with(blocks, starts, within))


def _with_matches(df: DataFrame, jobs: list[tuple[str, int, Column, Column]]) -> DataFrame:
    """df (text and others) with a span column for each (name, kind, pattern, condition). Matches, pieces and blocks are
    columns of their own first, each used twice, so that each is computed once."""
    cols = df.columns
    none = F.expr("CAST(array() AS array<string>)")
    out = df.select(*cols, *[F.when(c, F.regexp_extract_all("text", p, F.lit(0))).otherwise(none).alias(f"{n}_f") for n, _, p, c in jobs])
    out = out.select(*out.columns, *[F.when(F.size(f"{n}_f") > 0, F.split("text", p, -1)).otherwise(none).alias(f"{n}_p") for n, _, p, _ in jobs])
    both = lambda n: F.zip_with(F.slice(F.col(f"{n}_p"), 1, F.size(f"{n}_f")), F.col(f"{n}_f"), lambda p, m: F.struct(p.alias("gap"), m.alias("value")))
    out = out.select(*cols, *[both(n).alias(f"{n}_b") for n, *_ in jobs])
    out = out.select(*cols, *[_blocks(f"{n}_b").alias(f"{n}_b") for n, *_ in jobs])
    return out.select(*cols, *[F.filter(_located(f"{n}_b", k), _checker(KINDS[k])).alias(n) for n, k, _, _ in jobs])


def with_base_spans(df: DataFrame) -> DataFrame:
    """df with spans: (start, kind number, end, value) of the four kinds, in order of start, then kind; null text: none."""
    text = F.col("text")
    jobs = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        some = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike(pattern)
        jobs.append((f"_{kind}", k, F.lit(pattern), F.coalesce(some, F.lit(False))))
    return _with_matches(df, jobs).select(*df.columns, F.array_sort(F.concat(*[n for n, *_ in jobs])).alias("spans"))


def _entities(span: Column) -> Column:
    """What a span stands for, however it is written: the value, and what it shares with its like."""
    value, kind = span["value"], span["kind"]
    low, digits = F.lower(value), F.regexp_replace(value, "[^0-9]", "")
    key = lambda name, v: F.concat(F.lit(f"{name}:"), v)
    return (F.when(kind == 0, F.array(key("email", low), key("user", F.substring_index(low, "@", 1)), key("domain", F.substring_index(low, "@", -1))))
            .when(kind == 1, F.array(key("ip", value), key("network", F.substring_index(value, ".", 3))))
            .when(kind == 2, F.array(key("card", digits)))
            .otherwise(F.array(key("phone", digits), key("exchange", F.regexp_replace(digits, "[0-9]{4}$", "")))))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}+"), F.lit(0))


#: Characters on either side of a span that may be its context.
NEAR = 16 * CONTEXT


def _context(piece: Column, at: Column, s: Column) -> Column:
    """CONTEXT words on either side, from a window of NEAR characters; words that its edge cuts are left out. piece is the text from `at` on."""
    left = F.substring(piece, F.greatest(s["start"] - NEAR, F.lit(0)) - at + 1, F.least(s["start"], F.lit(NEAR)))
    left = F.when(s["start"] > NEAR, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
    right = F.regexp_replace(F.substring(piece, s["end"] - at + 1, F.lit(NEAR)), r"\p{L}+$", "")
    return _let(_words(left), lambda lw: F.concat(F.slice(lw, F.greatest(F.size(lw) - CONTEXT, F.lit(0)) + 1, F.lit(CONTEXT)), F.slice(_words(right), 1, CONTEXT)))


def mentions(docs: DataFrame) -> DataFrame:
    """(md5, m, near, entities, words) of each text with a base span, and of how many rows it is (m).

    near has the entities and the context words of each span, words all words of the text.
    """
    found = with_base_spans(docs.select("text")).withColumn("_at", F.monotonically_increasing_id())
    found = found.where((F.size("spans") > 0) & (F.col("_at") >= 0))  # the number keeps Catalyst from computing the spans again within the filter
    found = found.select("text", "spans").select("text", _blocks("spans").alias("blocks"))
    first = lambda b: F.greatest(F.element_at(b, 1)["start"] - NEAR, F.lit(0))
    piece = lambda b: F.substring(F.col("text"), first(b) + 1, F.array_max(F.transform(b, lambda s: s["end"])) + NEAR - first(b))
    near = F.flatten(F.transform("blocks", lambda b: _let(piece(b), lambda p: F.transform(b, lambda s: F.struct(_entities(s).alias("entities"), _context(p, first(b), s).alias("words"))))))
    out = found.select("text", near.alias("near")).select(_key("text").alias("md5"), "near", F.array_distinct(F.flatten(F.transform("near", lambda x: x["entities"]))).alias("entities"), F.array_distinct(_words(F.col("text"))).alias("words"))
    return out.groupBy("md5").agg(F.count("*").alias("m"), *[F.first(c).alias(c) for c in ("near", "entities", "words")])


def _key(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def held_terms(said: DataFrame, terms: DataFrame) -> DataFrame:
    """(md5, m, entity, term) of each text of said and each of the terms (entity, term) whose entity and term it holds."""
    asked = said.select("md5", "m", F.explode("entities").alias("entity")).join(terms.select("entity").distinct(), "entity", "left_semi")
    held = said.select("md5", F.explode("words").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    # by text, so that rows are bounded by what each text holds, not by the terms of an entity times its texts
    return asked.join(held, "md5").join(terms, ["entity", "term"], "left_semi").select("md5", "m", "entity", "term")


def disclosing_terms(docs: DataFrame, said: DataFrame) -> DataFrame:
    """(entity, term, disclosure) of the terms that reach DISCLOSURE; said is `mentions` of docs."""
    n = docs.count()
    spans = said.select(F.explode("near").alias("s")).select("s.words", F.xxhash64("s.words").alias("context"), F.explode("s.entities").alias("entity"))
    contexts = spans.select("entity", "context", F.explode("words").alias("term")).distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts"))
    n_e = said.select("m", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("m").alias("n_e"))
    num = lambda c: F.col(c).cast("double")
    bits = F.log(F.lit(float(n)) / num("n_e"))
    # n_te is n_e at most, and n_t at least the texts with a base span that hold t: terms too common to disclose e go now
    n_in = said.select("m", F.explode("words").alias("term")).groupBy("term").agg(F.sum("m").alias("n_in"))
    can = (F.col("n_e") < n) & (F.log(F.least(F.lit(1.0), num("n_e") / num("n_in"))) + bits >= F.lit(DISCLOSURE) * bits - 1e-9)
    seen = contexts.where(F.col("contexts") >= SUPPORT).join(n_e, "entity").join(n_in, "term")
    seen = stored(seen.where(can).select("entity", "term"), "supported")
    n_te = held_terms(said, seen).groupBy("entity", "term").agg(F.sum("m").alias("n_te"))
    cand = stored(n_te.join(n_e, "entity"), "candidates")
    terms = stored(cand.select("term").distinct(), "terms")
    each = docs.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
    n_t = each.groupBy("term").agg(F.count("*").alias("n_t")).join(terms, "term")
    pmi = F.log(F.lit(float(n)) * num("n_te") / (num("n_t") * num("n_e")))
    return cand.join(n_t, "term").where(F.col("n_e") < n).select("entity", "term", (pmi / bits).alias("disclosure")).where(F.col("disclosure") >= DISCLOSURE)


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans, base) of each row of docs: all spans and the base ones, in order of start, then kind.

    Takes doc_id and text, ignores other columns; a null text has no spans and
    comes back null. Rows that repeat keep a row each. An empty table gives
    no rows.
    """
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return _find(src)


def _find(src: DataFrame) -> DataFrame:
    """src (text and others) with spans and base."""
    said = stored(mentions(src), "mentions")
    reveal = stored(disclosing_terms(src.select("text"), said).select("entity", "term"), "disclosing")
    own = stored(held_terms(said, reveal.distinct()).groupBy("md5").agg(F.array_join(F.array_sort(F.collect_set("term")), "|").alias("terms")), "own_terms")
    rest = [c for c in src.columns if c != "text"]
    keyed = src.select(F.struct(*rest).alias("_rest"), "text", _key("text").alias("_md5"))
    joined = keyed.join(own.withColumnRenamed("md5", "_md5"), "_md5", "left").select("_rest", "text", "terms")
    spans = with_base_spans(joined)
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.coalesce("terms", F.lit("")), F.lit(r")(?!\p{L})"))
    out = _with_matches(spans, [("_term", 4, pattern, F.col("terms").isNotNull() & F.col("text").isNotNull())])
    return out.select("_rest.*", "text", F.array_sort(F.concat("spans", "_term")).alias("spans"), F.col("spans").alias("base"))


def written(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counts(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def replaced(df: DataFrame, cols: list[str]) -> DataFrame:
    """cols of df (text, spans) and _new: the text with every span replaced by its kind in brackets."""
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    out = df.select(*cols, "text", "spans").select(*cols, "text", "spans", _blocks("spans").alias("_blocks"))
    ends = _carried("_blocks", lambda at, b: F.greatest(at, F.array_max(F.transform(b, lambda x: x["end"]))))
    out = out.select(*cols, "text", "spans", "_blocks", ends.alias("_ends"))
    step = lambda piece, s: lambda a, x: F.struct(
        F.greatest(a["at"], x["end"]).alias("at"),
        F.when(x["start"] >= a["at"], F.array_append(a["out"], F.concat(F.substring(piece, a["at"] - s + 1, x["start"] - a["at"]), F.element_at(labels, x["kind"] + 1)))).otherwise(a["out"]).alias("out"))
    within = lambda b, s: _let(
        F.substring(F.col("text"), s + 1, F.greatest(F.element_at(b, -1)["start"] - s, F.lit(0))),
        lambda piece: F.array_join(F.aggregate(b, F.struct(s.alias("at"), F.expr("CAST(array() AS array<string>)").alias("out")), step(piece, s), lambda a: a["out"]), ""))
    last = F.array_max(F.transform("spans", lambda x: x["end"]))
    new = F.concat(F.array_join(F.zip_with("_blocks", "_ends", within), ""), F.substring(F.col("text"), last + 1, F.length("text")))
    return out.select(*cols, F.when(F.size("spans") > 0, new).otherwise(F.col("text")).alias("_new"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with every span of its text replaced by its kind in brackets: [EMAIL], [IP], [CARD], [PHONE], [TERM].

    Overlapping spans become one, under the first one's kind. All columns stay;
    n_chars, if there, becomes the new length. Null texts stay null.
    """
    src = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"), "text")
    out = replaced(_find(src), ["_row"])
    cols = []
    for f in docs.schema.fields:
        c = F.col("_new") if f.name == "text" else F.col(f"_row.`{f.name}`")
        if f.name == "n_chars":
            c = F.when(F.col("_new").isNull(), c).otherwise(F.length("_new").cast(f.dataType))
        cols.append(c.alias(f.name))
    return out.select(*cols)
