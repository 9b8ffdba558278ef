"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the identifiers that fixed patterns find (email, ip, card, phone) and, of the long runs of letters
and digits that a name is set to (``token = "..."``), a share. The two words before an identifier are a
lexical pattern, and so are the two after it. Patterns and the identifier-like tokens beside them form a
graph that is scored in rounds. A pattern is as good as the share of its occurrences in the corpus that are
beside known identifiers, or beside tokens of the same shape as one that is known beside this very pattern;
anything else there, plain words too, speaks against it. An unseen token is as good as its best pattern,
and tokens found in one round support patterns in the next. Labelled seeds and tokens of high-confidence
patterns are added as kind 'id'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small

#: The kinds in their order, and the pattern of each. Runs are entered at their start (or where
#: the last match ended) and never given back, so that matching takes linear time.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: An identifier-like token: no white space, with a digit or '@'.
TOKEN = r"(?:\G|(?<!\S))[^\s0-9@]*+[0-9@]\S*+"


#: A seed of kind id: so long a run of letters and digits, at least one of each, in a token that a name is set to.
RUN = r"[A-Za-z0-9+/_-]{20,}+"
#: Such a run at the end; runs are entered at their start only.
LAST_RUN = rf"(?<![A-Za-z0-9+/_-]){RUN}$"
LABELLED = rf"^[^A-Za-z\s=:]*+[A-Za-z][^\s=:]*+[=:][\"']?{RUN}"
BLOCK = 64


def _let(value: Column, body) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: int, op) -> Column:
    """For each of values (array<int>) the combination by op (zero: its neutral value) of all before it.

    In two levels, blocks of BLOCK values and then within them, so that no long array is copied for every value.
    """
    start = F.array(F.lit(zero))
    follow = lambda acc, v: F.array_append(acc, op(F.element_at(acc, -1), v))

    def combined(blocks: Column) -> Column:
        bases = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, F.lit(zero), op)), start, follow)
        inner = lambda b, base: F.aggregate(b, F.array(base), follow, lambda acc: F.slice(acc, F.lit(1), F.size(b)))
        return F.flatten(F.zip_with(blocks, F.slice(bases, F.lit(1), F.size(blocks)), inner))

    last = lambda v: F.greatest(F.floor((F.size(v) - 1) / BLOCK), F.lit(0)).cast("int")
    blocks = _let(values, lambda v: F.transform(F.sequence(F.lit(0), last(v)), lambda b: F.slice(v, b * BLOCK + 1, BLOCK)))
    return _let(blocks, combined)


def matches(df: DataFrame, text: str, regex: str, out: str, needs: str) -> DataFrame:
    """Adds out: the matches of regex in order, as array of (start, end, hit, before, after), in code points.

    before: the last characters of the text between this match and the last one; after: the first ones up
    to the next. needs: a cheap pattern without which there can be no match. Takes linear time.
    """
    hits, gaps, at = f"_{out}_hits", f"_{out}_gaps", f"_{out}_at"
    none = F.array().cast("array<struct<start:int,end:int,hit:string,before:string,after:string>>")
    found = F.when(F.col(text).rlike(needs), F.regexp_extract_all(F.col(text), F.lit(regex), F.lit(0)))
    df = df.withColumn(hits, found)
    df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.split(F.col(text), regex, -1)))
    sizes = F.zip_with(F.slice(F.col(gaps), F.lit(1), F.size(hits)), F.col(hits), lambda g, h: F.length(g) + F.length(h))
    df = df.withColumn(at, F.when(F.col(gaps).isNotNull(), running(sizes, 0, lambda a, b: a + b)))
    one = lambda x: F.struct(
        (x["at"] + F.length(x["gap"])).alias("start"),
        (x["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"),
        x["hit"].alias("hit"),
        F.right(x["gap"], F.lit(80)).alias("before"),
        F.left(x["next"], F.lit(80)).alias("after"),
    )
    zipped = F.arrays_zip(F.slice(F.col(gaps), F.lit(1), F.size(hits)).alias("gap"), F.slice(F.col(gaps), F.lit(2), F.size(hits)).alias("next"), F.col(hits).alias("hit"), F.col(at).alias("at"))
    return df.withColumn(out, F.when(F.col(gaps).isNotNull(), F.transform(zipped, one)).otherwise(none)).drop(hits, gaps, at)


def touched(tokens: Column, spans: Column) -> Column:
    """Which of tokens (in order) a span overlaps, as array<boolean>: running maxima of ends and minima of starts over both, by start."""
    each = lambda x, span: F.struct(x["start"].alias("start"), F.lit(not span).alias("token"), x["end"].alias("end"))
    last = 2**31 - 1

    def seen(both: Column) -> Column:
        ends = running(F.transform(both, lambda x: F.when(x["token"], 0).otherwise(x["end"])), 0, lambda a, b: F.greatest(a, b))
        starts = F.reverse(running(F.reverse(F.transform(both, lambda x: F.when(x["token"], last).otherwise(x["start"]))), last, lambda a, b: F.least(a, b)))
        hit = lambda z: F.struct(z["x"]["token"].alias("token"), ((z["e"] > z["x"]["start"]) | (z["s"] < z["x"]["end"])).alias("hit"))
        return F.transform(F.arrays_zip(both.alias("x"), ends.alias("e"), starts.alias("s")), hit)

    both = F.array_sort(F.concat(F.transform(spans, lambda x: each(x, True)), F.transform(tokens, lambda x: each(x, False))))
    return F.transform(F.filter(_let(both, seen), lambda z: z["token"]), lambda z: z["hit"])


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(turned, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", "")), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    d = _digits(hit)
    if kind == "card":
        return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)
    return F.length(d).between(9, 15)


def _kept(kind: str) -> Column:
    kept = F.filter(F.col(kind), lambda m: _valid(kind, m["hit"]))
    return F.transform(kept, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _context(before: Column) -> Column:
    """'<' and the last two words before a token, in lower case; null if the last has no letter or sign of assignment."""
    two = F.regexp_extract(F.lower(before), r"(\S{1,38}\s{1,4}\S{1,38})\s{1,4}$", 1)
    return F.when(two.rlike(r"[\p{L}:=#]\S*$"), F.concat(F.lit("<"), F.regexp_replace(two, r"\s+", " ")))


def _context_after(after: Column) -> Column:
    """'>' and the two words after a token, in lower case; null if the first has no letter."""
    two = F.regexp_extract(F.lower(after), r"^\s{1,4}(\S{1,38}\s{1,4}\S{1,38})(?:\s|$)", 1)
    return F.when(two.rlike(r"^\S*\p{L}"), F.concat(F.lit(">"), F.regexp_replace(two, r"\s+", " ")))


def shape(value: Column) -> Column:
    """What a token looks like: its runs of letters, digits and +/_- as one sign, what it is made of, and the power of two of its length."""
    plain = F.left(F.regexp_replace(value, r"[\p{L}0-9+/_-]++", "x"), F.lit(40))
    made = F.concat(F.when(value.rlike(r"\p{L}"), "L").otherwise(""), F.when(value.rlike("[0-9]"), "D").otherwise(""))
    return F.concat_ws(":", plain, made, F.floor(F.log2(F.length(value))).cast("string"))


def occurrences(texts: DataFrame, patterns: DataFrame, most_literals: int = 5000) -> DataFrame:
    """How often the two words of each of the given patterns occur in the texts: pattern, occurs.

    Up to most_literals patterns are a set within the expression, so that only their occurrences become
    rows; more are joined.
    """
    words = F.filter(F.split(F.lower(F.col("text")), r"\s+"), lambda w: w != "")
    pairs = F.zip_with(F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w) - 1)"), lambda a, b: F.concat(a, F.lit(" "), b))
    wanted = patterns.select(F.substring("pattern", 2, 1 << 20).alias("said")).distinct()
    n = wanted.count()
    if n <= most_literals:
        known = [r[0] for r in wanted.collect()]
        pairs = F.filter(pairs, lambda p: p.isin(known))
    said = texts.select(words.alias("w")).where(F.size("w") > 1).select(F.explode(pairs).alias("said"))
    if n > most_literals:
        said = said.join(small(wanted, n, 120), "said", "left_semi")
    counts = said.groupBy("said").agg(F.count("*").alias("occurs"))
    return patterns.select("pattern", F.substring("pattern", 2, 1 << 20).alias("said")).join(counts, "said").select("pattern", "occurs")


def find_personal_data(docs: DataFrame, rounds: int = 3, least_support: int = 3, confidence: float = 0.8, smoothing: float = 1.0, seed_share: float = 1.0) -> DataFrame:
    """Finds personal data in docs (doc_id, text).

    A pattern needs ``least_support`` different identifiers known beside it and a share of known
    identifiers, and of tokens of the shape of one of them, of at least ``confidence`` among all its
    occurrences in the corpus (plus ``smoothing``), whatever is beside it there. seed_share: the share of
    labelled runs (by a hash of their value) that are seeds; the others are found by patterns or not at all.

    Returns a row per document: doc_id, n_email, n_ip, n_card, n_phone, n_id (long), base and spans (arrays
    of kind, start, end, by kind and start; code points, end exclusive; spans has the labelled seeds and
    what the patterns discovered too, as kind 'id').

    Null text counts as empty, a null doc_id is returned as null. Repeated rows are searched each on its
    own. Texts of any length are searched whole, in linear time. An empty table gives no rows. Other
    columns are ignored.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = base
    needs = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
    for kind, regex in zip(KINDS, (EMAIL, IP, CARD, PHONE)):
        rows = matches(rows, "text", regex, kind, needs[kind])
        rows = rows.withColumn(kind, _kept(kind))
    rows = matches(rows, "text", TOKEN, "tokens", "[0-9@]")
    rows = rows.select("row", "doc_id", *KINDS, F.concat(*KINDS).alias("base"), "tokens")
    # A token is known if a span of the base lies on it, or if it is a labelled seed; quotes and punctuation are not part of it.
    def mention(t: Column, touched: Column) -> Column:
        head = F.length(F.regexp_extract(t["hit"], r"^[^\p{L}0-9+]{1,9}", 0))
        value = F.regexp_replace(F.substring(t["hit"], head + 1, F.length(t["hit"])), r"[^\p{L}0-9]{1,9}$", "")
        before = _context(t["before"])
        run = F.regexp_extract(value, LAST_RUN, 0)
        named = F.coalesce(before.rlike("[=:]$") & value.rlike(f"^{RUN}$"), F.lit(False)) | value.rlike(LABELLED)
        seed = named & run.rlike("[0-9]") & run.rlike("[A-Za-z]")
        if seed_share < 1:
            seed = seed & (F.pmod(F.xxhash64(F.lower(value)), F.lit(1 << 20)) < int(seed_share * (1 << 20)))
        start = t["start"] + head
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), F.lower(value).alias("value"), touched.alias("base"), (seed & ~touched).alias("seed"), (touched | seed).alias("known"), F.array_compact(F.array(before, _context_after(t["after"]))).alias("patterns"))

    rows = rows.withColumn("touched", F.when(F.size("tokens") > 0, touched(F.col("tokens"), F.col("base"))).otherwise(F.array().cast("array<boolean>")))
    rows = saved(rows.withColumn("mentions", F.zip_with("tokens", "touched", mention)).drop("tokens", "touched"), "spans")

    edges = rows.select(F.explode("mentions").alias("m")).where("m.value <> ''").select("m.value", "m.known", F.explode("m.patterns").alias("pattern"))
    edges = edges.groupBy("pattern", "value").agg(F.count("*").alias("n"), F.max("known").alias("known"), F.max(~F.col("known")).alias("open"))
    edges = saved(edges, "edges")
    known = edges.where("known").select("value").distinct().withColumn("score", F.lit(1.0))
    # What no round can trust is left out. Words of shorter patterns are whole, so these occur before_ids times at least.
    cut_words = F.length("pattern") >= 41
    support = edges.groupBy("pattern").agg(F.count("*").alias("values"), F.max("open").alias("open"), F.sum("n").alias("before_ids"))
    able = support.where(F.col("open") & (F.col("values") >= least_support) & (cut_words | (F.col("before_ids") / (F.col("before_ids") + smoothing) >= confidence)))
    edges = edges.join(able.select("pattern", "before_ids"), "pattern").join(known, "value", "left")
    edges = saved(edges.select("pattern", "value", shape(F.col("value")).alias("shape"), "n", "before_ids", F.coalesce("score", F.lit(0.0)).alias("score")), "edges")
    # Upper bound of what each round can find: as if every pattern with support were trusted.
    reached, wanted = edges.where("score > 0").select("value").distinct(), edges.select("pattern", "before_ids").limit(0)
    for k in range(rounds):
        hopeful = edges.join(reached.withColumn("near", F.lit(1)), "value", "left").groupBy("pattern", "before_ids", "shape").agg(F.count("near").alias("support"), F.sum("n").alias("n"))
        hopeful = hopeful.where("support > 0").groupBy("pattern", "before_ids").agg(F.sum("support").alias("support"), F.sum("n").alias("seen"))
        hopeful = hopeful.where((F.col("support") >= least_support) & (cut_words | (F.col("seen") / (F.col("before_ids") + smoothing) >= confidence)))
        wanted = saved(hopeful.select("pattern", "before_ids"), "patterns")
        if k < rounds - 1:
            reached = saved(reached.union(edges.join(wanted.select("pattern"), "pattern").select("value")).distinct(), "reached")
    if wanted.limit(1).count():
        # Texts with identifiers alone show already that most of these patterns occur too often to be trusted.
        some = occurrences(base.where(F.col("text").rlike("[0-9@]")), wanted)
        trusted = F.col("before_ids") / (F.col("occurs") + smoothing) >= confidence
        wanted = saved(wanted.join(some, "pattern").where(trusted).select("pattern"), "patterns")
    found = None
    if wanted.limit(1).count():
        edges = saved(edges.join(occurrences(base, wanted), "pattern"), "edges")
        scores = edges.groupBy("value").agg(F.max("score").alias("score"))
        edges = edges.drop("score")
        for _ in range(rounds):
            graph = edges.join(scores, "value")
            shapes = graph.groupBy("pattern", "shape").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("score")).alias("sure"), F.count_if(F.col("score") >= confidence).alias("support"), F.max("occurs").alias("occurs"))
            alike = F.when(F.col("support") > 0, F.col("n")).otherwise(F.col("sure"))
            patterns = shapes.groupBy("pattern").agg((F.sum(alike) / (F.max("occurs") + smoothing)).alias("p"), F.sum("support").alias("support"))
            good = patterns.where((F.col("p") >= confidence) & (F.col("support") >= least_support)).select("pattern", "p")
            best = edges.join(good, "pattern").groupBy("value").agg(F.max("p").alias("p"))
            scores = saved(scores.join(best, "value", "left").select("value", F.greatest("score", F.coalesce("p", F.lit(0.0))).alias("score")), "scores")
        found = good if rounds else None
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    span = lambda m: F.struct(F.lit("id").alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    ids = F.transform(F.filter("mentions", lambda m: m["seed"]), span)
    if found is not None:
        beside = rows.select("row", F.explode("mentions").alias("m")).where("not m.known and m.value <> ''").select("row", "m", F.explode("m.patterns").alias("pattern"))
        beside = beside.join(small(found.select("pattern"), found.count(), 120), "pattern", "left_semi")
        more = beside.groupBy("row").agg(F.collect_set(span(F.col("m"))).alias("more"))
        rows = rows.join(more, "row", "left")
        ids = F.array_sort(F.concat(ids, F.coalesce("more", empty)))
    rows = rows.withColumn("ids", ids)
    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in (*KINDS, "ids")], "base", F.concat("base", "ids").alias("spans")).withColumnRenamed("n_ids", "n_id")


def joined_spans(spans: str) -> Column:
    """kind:start:end of a span array, comma-joined."""
    return _joined(F.col(spans))
