"""Personal data: fixed patterns, widened by bootstrapped contexts, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import discard, documents, written

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)  # a kind without a base pattern: keys and tokens, found by context only
AGAINST = -1  # of an occurrence that speaks against its patterns and is never discovered
NAMES = (*KINDS, "secret")

#: The base patterns.  Possessive repeats and the look-behinds (a match
#: starts where its run starts, or where the last match ended) find the same matches
#: without trying every place of a long run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}

OPENING, CLOSING = r"(\[{<'", r".,;:!?)\]}>'"  # marks around a word, for character classes
APART = r"\s=\x22"  # what parts words; of these = is a word for its neighbours
#: A word with a digit or @, of any length, without the marks around it (but for opening
#: ones beyond eight).
CANDIDATE = rf"(?:(?<=^|[{APART}]|(?:^|[{APART}])[{OPENING}]{{1,8}})(?=[^{APART}{OPENING}])|(?<=(?:^|[{APART}])[{OPENING}]{{8}}))(?=[^{APART}0-9@]*+[0-9@])[^{APART}]*[^{APART}{CLOSING}]"
#: Seeds of SECRET: long runs that mix letters and digits.  They count as evidence for
#: the words around them, and are found only where such words turn out reliable.
SECRET_SEED = r"^(?=(?:[^0-9]*+[0-9]){4})(?=(?:[^A-Za-z]*+[A-Za-z]){4})[A-Za-z0-9+/_]{20,}+=*+$"
#: Names of such runs that are no secrets.
INNOCENT = r"(?:^|\s)(?:commit|revision|sha-?1|sha-?256|sha-?512|md5|crc|hash|digest|checksum|etag|uuid|integrity):?(?:\s=)?$"

LEFT, RIGHT = 60, 40  # characters in which the neighbouring words are looked for first
WIDER = 16  # times so many, and again, where they do not hold the words whole; then all
LONG = 120  # longer patterns and values are kept as their hash
SETTLED = 1e-6  # change of all confidences together that counts as none
MIN_SEEDS = 5.0  # distinct instances that speak for a pattern
MIN_PATTERN = 0.8
OPEN_WEIGHT = 0.5  # what a candidate of no known kind counts against a pattern
MIN_INSTANCE = 0.85


BLOCK = 64


def scan(array: Column, first: Column, step, kind: str) -> Column:
    """What step(state, x) -> (state, y) gives for each x in turn, as an array of kind.

    Spark has no running fold of arrays, and appending one by one copies what is there
    each time; so a block's results are appended to each other, then blocks to blocks.
    """

    def one(so_far: Column, x: Column) -> Column:
        state, y = step(so_far["state"], x)
        return F.struct(state.alias("state"), F.concat(so_far["out"], F.array(y)).cast(f"array<{kind}>").alias("out"))

    def block(so_far: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(so_far["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out")), one)
        both = lambda r: F.struct(r["state"].alias("state"), F.concat(so_far["out"], F.array(r["out"])).cast(f"array<array<{kind}>>").alias("out"))
        return F.transform(F.array(inner), both)[0]

    def whole(x: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(x), F.lit(BLOCK))
        blocks = F.transform(starts, lambda at: F.slice(x, at, F.lit(BLOCK)))
        none = F.struct(first.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(x) > 0, F.aggregate(blocks, none, block, lambda r: F.flatten(r["out"]))).otherwise(F.array().cast(f"array<{kind}>"))

    return F.transform(F.array(array), whole)[0]  # the array is made once


def matches(text: Column, pattern: str) -> Column:
    """All matches, leftmost and not overlapping, as structs (start, end, value) in code points.

    What lies between the matches gives their places: both are taken in one walk.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    parts = F.filter(parts, lambda p: p["hit"].isNotNull())

    def step(at: Column, part: Column) -> tuple[Column, Column]:
        start = at + F.length(part["before"])
        end = start + F.length(part["hit"])
        return end, F.struct(start.alias("start"), end.alias("end"), part["hit"].alias("value"))

    return scan(parts, F.lit(0), step, "struct<start:int,end:int,value:string>")


def apart(spans: Column, others: Column) -> Column:
    """Those of spans (start, end, value) that overlap none of the others, by two walks in order."""
    kind = "struct<start:int,own:boolean,end:int,value:string,hit:boolean>"

    def typed(x: Column, own: bool) -> Column:
        return F.transform(x, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s["value"].alias("value"), F.lit(False).alias("hit")))

    def mark(s: Column, hit: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["own"].alias("own"), s["end"].alias("end"), s["value"].alias("value"), (s["hit"] | (s["own"] & hit)).alias("hit"))

    def ahead(reach: Column, s: Column) -> tuple[Column, Column]:
        return F.when(s["own"], reach).otherwise(F.greatest(reach, s["end"])), mark(s, s["start"] < reach)

    def back(next_: Column, s: Column) -> tuple[Column, Column]:
        return F.when(s["own"], next_).otherwise(F.least(next_, s["start"])), mark(s, s["end"] > next_)

    in_order = F.sort_array(F.concat(typed(others, False), typed(spans, True)))
    once = F.reverse(scan(in_order, F.lit(0), ahead, kind))
    return F.filter(scan(once, F.lit((1 << 31) - 1), back, kind), lambda s: s["own"] & ~s["hit"])


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))
    from_right = F.reverse(digits)

    def add(total: Column, place: Column) -> Column:
        d = F.substring(from_right, place, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(place % 2 == 0, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of a kind's pattern is one."""
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), part)
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def _checker(kind: str):
    return lambda s: _holds(kind, s["value"])


def _refuted(kind: str):
    """Whether a match has all of its kind but fails the check: a card's length without its sum, an address out of range."""
    digits = lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", ""))
    return lambda s: ~_holds(kind, s["value"]) & (digits(s).between(13, 19) if kind == "card" else F.lit(True))


def _of_kind(spans: Column, kind: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_spans(text: Column) -> Column:
    """The fixed patterns' spans as structs (kind number, start, end, value), by kind, then start."""
    found = []
    for k, kind in enumerate(KINDS):
        typed = _of_kind(F.filter(matches(text, PATTERNS[kind]), _checker(kind)), F.lit(k))
        possible = F.contains(text, F.lit(NEEDED[kind])) if NEEDED[kind] else F.lit(True)
        found.append(F.when(possible, typed).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")))
    some = F.when(text.rlike("[0-9@]"), F.concat(*found))
    return F.coalesce(some, F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>"))


PIECE = 1000


def in_pieces(text: Column, use) -> Column:
    """use(pieces), pieces being text cut every PIECE characters: a place is found without a walk from the start."""
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))), use)[0]


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """Characters start to end of the text in pieces, at the cost of what is cut."""
    first = F.floor(start / PIECE).cast("int")
    held = F.array_join(F.slice(pieces, first + 1, F.greatest(F.ceil(end / PIECE).cast("int") - first, F.lit(0))), "")
    return F.when(end > start, F.substring(held, start - first * PIECE + 1, end - start)).otherwise("")


def shape(value: Column) -> Column:
    """A word's form: 9 for digits, A and a for letters, runs as one; x for what mixes them much.

    Where only 9 or x is left, the number of characters follows.
    """
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\p{Nd}", "9"), r"\p{Lu}", "A"), r"\p{L}", "a")
    runs = F.regexp_replace(F.regexp_replace(kinds, r"(.)\1++", "$1"), "[9aA]{5,}+", "x")
    return F.transform(F.array(runs), lambda r: F.when(r.isin("9", "x"), F.concat(r, F.length(value))).otherwise(r))[0]


def _short(x: Column) -> Column:
    return F.when(F.length(x) > LONG, F.concat(F.substring(x, 1, 2), F.sha2(x, 256))).otherwise(x)


def _contexts(pieces: Column, start: Column, end: Column, value: Column) -> Column:
    """Lexical patterns of a span, null where a part is missing.

    The two words before it; the word on either side; its own shape; its shape after the
    word before it; its shape before the word after it.  Marks next to it are left out.
    """
    all_ = (F.size(pieces) * PIECE).cast("int")

    def widened(taken, whole: str, width: int, turns: int = 2) -> Column:
        """What is taken in the first width that holds whole, or reaches the text's end."""
        if not turns:
            return taken(all_)
        held = lambda t: F.when(t.rlike(whole) | (F.length(t) < width), t).otherwise(widened(taken, whole, width * WIDER, turns - 1))
        return F.transform(F.array(taken(F.lit(width))), held)[0]

    left = widened(lambda w: cut(pieces, F.greatest(start - w, F.lit(0)), start), r"\s\S++\s++\S++\s*+$", LEFT)
    right = widened(lambda w: cut(pieces, end, end + w), r"^\S*+\s++\S++\s", RIGHT)

    word, begins = r"(?:=|[^\s=]++)", r"(?:(?<![^\s=])|(?==))"

    def parts(sides: Column) -> Column:
        two = F.regexp_extract(sides["left"], rf"{begins}({word}\s*+{word})\s*+$", 1)
        one = F.regexp_extract(sides["left"], rf"{begins}({word})\s*+$", 1)
        after = F.regexp_extract(sides["right"], rf"^[^\s=]*+\s*+({word})", 1)
        return F.struct(two.alias("two"), one.alias("one"), after.alias("after"), shape(value).alias("form"))

    def patterns(x: Column) -> Column:
        found = F.array(
            F.when(x["two"] != "", F.concat(F.lit("L "), F.regexp_replace(F.replace(x["two"], F.lit("="), F.lit(" = ")), r"\s+", " "))),
            F.when((x["one"] != "") | (x["after"] != ""), F.concat(F.lit("B "), x["one"], F.lit(" _ "), x["after"])),
            F.concat(F.lit("S "), x["form"]),
            F.when(x["one"] != "", F.concat(F.lit("P "), x["one"], F.lit(" "), x["form"])),
            F.when(x["after"] != "", F.concat(F.lit("F "), x["form"], F.lit(" "), x["after"])),
        )
        return F.transform(found, _short)

    before = F.regexp_replace(F.lower(left), rf"(?<![\x22{OPENING}])[\x22{OPENING}]++$", "")
    sides = F.array(F.struct(before.alias("left"), F.lower(right).alias("right")))
    return F.transform(F.transform(sides, parts), patterns)[0]


OCCURRENCE = "array<struct<kind:int,start:int,end:int,value:string,patterns:array<string>>>"


def occurrences(text: Column, base: Column, hidden=None) -> Column:
    """Base spans, and the candidates that touch none, each with its patterns.

    kind is null for a candidate, SECRET for one that looks like a secret, AGAINST for
    what a base pattern's check refused and for secrets' likes of an innocent name.
    hidden(value), if given, tells which base spans are shown as candidates: how well
    they are found again can then be measured.
    """
    failed = F.concat(*[F.filter(matches(text, PATTERNS[k]), _refuted(k)) for k in ("ip", "card")])
    failed = _of_kind(apart(failed, base), F.lit(AGAINST))
    kept = base if hidden is None else F.transform(base, lambda s: s.withField("kind", F.when(~hidden(s["value"]), s["kind"])))

    def others(refused: Column) -> Column:
        free = apart(matches(text, CANDIDATE), F.concat(base, refused))
        guess = lambda s: F.when(s["value"].rlike(SECRET_SEED), SECRET)
        free = F.transform(free, lambda s: F.struct(guess(s).cast("int").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
        return F.concat(kept, refused, free)

    def named(s: Column, patterns: Column) -> Column:
        kind = F.when((s["kind"] == SECRET) & F.coalesce(patterns[0].rlike(INNOCENT), F.lit(False)), AGAINST).otherwise(s["kind"])
        return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _short(s["value"]).alias("value"), patterns.alias("patterns"))

    def placed(pieces: Column) -> Column:
        every = F.transform(F.array(failed), others)[0]
        return F.transform(every, lambda s: F.transform(F.array(_contexts(pieces, s["start"], s["end"], s["value"])), lambda p: named(s, p))[0])

    return F.when(text.rlike("[0-9@]"), in_pieces(text, placed).cast(OCCURRENCE)).otherwise(F.array().cast(OCCURRENCE))


def bootstrap(edges: DataFrame, min_seeds: float = MIN_SEEDS, min_pattern: float = MIN_PATTERN, min_instance: float = MIN_INSTANCE) -> DataFrame:
    """(value, kind, confidence) of instances that high-confidence patterns discover.

    edges: distinct (pattern, value, kind); kind is null for candidates and AGAINST for
    what speaks against its patterns.  A seed is certain of its kind.  A pattern's score
    for a kind is the confidence of its distinct instances of the kind over all its
    instances, candidates at OPEN_WEIGHT, and counts if at least min_seeds speak for it;
    a pattern that serves several kinds thus counts for none.  A candidate's confidence
    is what its patterns leave of the doubt (noisy or).  Seeds of SECRET are only likely
    ones: they are candidates too, for that kind alone, and no shape speaks for it, as
    its seeds were chosen by shape.  Each round the instances score the patterns anew,
    until one finds no new instance and leaves the confidences as they were; as more
    confidence never lowers another, that comes.
    """
    seeds = edges.where("kind >= 0").select("value", "kind").distinct().withColumn("confidence", F.lit(1.0))
    open_ = edges.where(F.col("kind").isNull() | (F.col("kind") == SECRET)).select("pattern", "value", F.col("kind").alias("only"))
    weighed = edges.groupBy("pattern", "value").agg(F.max(F.when(F.col("kind").isNull(), OPEN_WEIGHT).otherwise(1.0)).alias("weight"))
    sizes = weighed.groupBy("pattern").agg(F.sum("weight").alias("size"))
    pairs = edges.select("pattern", "value").distinct()
    by_shape = (F.col("kind") == SECRET) & F.col("pattern").startswith("S ")
    known, found, before = seeds, None, (0, 0.0)
    while True:
        support = pairs.join(known, "value").groupBy("pattern", "kind").agg(F.sum("confidence").alias("support"))
        scored = support.where(F.col("support") >= min_seeds).join(sizes, "pattern").withColumn("score", F.least(F.col("support") / F.col("size"), F.lit(0.99)))
        strong = written(scored.where((F.col("score") >= min_pattern) & ~by_shape).select("pattern", "kind", "score"), "patterns")
        doubt = F.exp(F.sum(F.log(1 - F.col("score"))))
        fits = open_.join(strong, "pattern").where("only is null or only = kind").select("pattern", "value", "kind", "score").distinct()
        judged = fits.groupBy("value", "kind").agg((1 - doubt).alias("confidence"))
        newer = written(judged.where(F.col("confidence") >= min_instance), "instances")
        discard(strong, found)
        found, known = newer, seeds.unionByName(newer).groupBy("value", "kind").agg(F.max("confidence").alias("confidence"))
        now = tuple(newer.agg(F.count(F.lit(1)), F.coalesce(F.sum("confidence"), F.lit(0.0))).first())
        if now[0] == before[0] and now[1] - before[1] < SETTLED:
            break
        before = now
    best = F.max(F.struct("confidence", (-F.col("kind")).alias("first")))
    return found.groupBy("value").agg(best.alias("best")).select("value", (-F.col("best.first")).alias("kind"), F.col("best.confidence").alias("confidence"))


def _key(doc_id: Column, text: Column) -> Column:
    return F.struct(doc_id.alias("doc_id"), F.xxhash64(text).alias("hash"))


def _edges(thin: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Single occurrences of a table of them by key, and their distinct (pattern, value, kind)."""
    each = thin.select("key", F.explode("spans").alias("s"))
    edges = each.select(F.explode("s.patterns").alias("pattern"), F.col("s.value").alias("value"), F.col("s.kind").alias("kind"))
    return each, edges.where("pattern is not null").distinct()


def personal_spans(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """docs' rows as (record struct, base, spans).

    base holds the fixed patterns' spans, spans these and the discovered ones, as structs
    (kind number, start, end, value) by kind, then start; ends are exclusive, in code
    points; the kinds are NAMES.  A null text holds nothing.  Whole texts are read however
    long they are.  Repeated rows get the same spans; a null doc_id is an id like any
    other; an empty table gives no rows.  carry names the columns to keep in record, where
    they cannot clash with these.
    """
    columns = docs.columns if carry is None else carry
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select(_key(F.col("doc_id"), text).alias("key"), text.alias("body"), base_spans(text).alias("base"))
    thin = written(thin.select("key", occurrences(F.col("body"), F.col("base")).alias("spans")).where("size(spans) > 0"), "occurrences")
    each, edges = _edges(thin)
    edges = written(edges, "edges")
    discovered = written(bootstrap(edges), "discovered")
    discard(edges)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("record"), _key(F.col("doc_id"), text).alias("key"), base_spans(text).alias("base"))
    if discovered.isEmpty():
        discard(thin)
        return rows.select("record", "base", F.col("base").alias("spans"))
    free = each.where(f"s.kind is null or s.kind = {SECRET}")
    more = free.select("key", "s.start", "s.end", "s.value").distinct().join(discovered, "value")
    more = more.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end", "value")).alias("more"))
    same = rows["key"].eqNullSafe(more["key"])
    joined = rows.join(more, same, "left")
    return joined.select("record", "base", F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(dict(rows.dtypes)["base"])))).alias("spans"))


def found_again(docs: DataFrame, hidden) -> DataFrame:
    """(value, truth, kind): the base values that hidden(value) hides, and the kind their patterns give them.

    Hidden values are candidates like any other; kind is null for one that is not found,
    truth for a found value that is no base value.  The check of discovery on known
    cases; SECRET, which has no base values, is left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select(_key(F.col("doc_id"), text).alias("key"), text.alias("body"), base_spans(text).alias("base"))
    truth = thin.select(F.explode("base").alias("s")).select(_short(F.col("s.value")).alias("value"), F.col("s.kind").alias("truth"), hidden(F.col("s.value")).alias("hid")).distinct()
    _, edges = _edges(thin.select("key", occurrences(F.col("body"), F.col("base"), hidden).alias("spans")))
    got = bootstrap(written(edges, "edges")).where(F.col("kind") != SECRET).select("value", "kind")
    return truth.where("hid").select("value", "truth").join(got, "value", "full_outer")


def joined_spans(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """text with each span, or run of overlapping spans, replaced by the first one's kind."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in NAMES])
    in_order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def whole(pieces: Column) -> Column:
        def step(at: Column, s: Column) -> tuple[Column, Column]:
            kept = F.concat(cut(pieces, at, s["start"]), F.get(names, s["kind"]))
            return F.greatest(at, s["end"]), F.when(s["start"] >= at, kept).otherwise("")

        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(scan(in_order, F.lit(0), step, "string"), ""), cut(pieces, last, F.length(text)))

    return F.when(F.size(spans) > 0, in_pieces(text, whole)).otherwise(text)


def op8_bootstrapped_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of personal data in every document; n_spans counts discovered ones too."""
    found = personal_spans(documents(spark, sf_dir).select("doc_id", "text"), carry=["doc_id"])
    counts = [_count("base", k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    base = joined_spans(F.col("base"))
    return found.select(F.col("record.doc_id").alias("doc_id"), *counts, F.sha2(base, 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
