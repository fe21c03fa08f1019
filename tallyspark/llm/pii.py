"""Personal data in whole texts, with DataFrame functions only: base patterns, then bootstrapped contextual extraction.

Base spans come from four patterns. They are the seeds. A base span, with all its words, is one instance, and every other word with a digit or an @; its patterns are the
letters of the word before it (``L:``), of the two before it (``LL:``), of the word behind it (``R:``) and of the two behind
it (``RR:``), whole words at whatever distance. The graph of patterns and instances is scored in ROUNDS rounds: a pattern's confidence for
a kind is the share of its distinct instances' scores that this kind has (one more instance, of no kind, being counted), and an
instance that isn't a seed beside the pattern takes the confidence of its best accepted pattern. Patterns of CONFIDENCE or more,
with SUPPORT seeds or more, then discover words of that kind's shape that no base span touches; marks around a word don't belong to it.

Nothing is held for a pattern or an instance but sums. A table is broadcast if its bytes are counted and few; a larger one is joined on
its key and a salt (``common.attached``), so that a frequent pattern or instance is no task of its own.

Positions are code points, ends exclusive. Nulls: a null text is an empty one; a null doc_id is carried. Repeated rows give
a row each. Empty tables give empty results, other columns are ignored by ``find`` and carried by ``redact``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, attached, materialize, small_or_plain

KINDS = ("email", "ip", "card", "phone")
ROUNDS, CONFIDENCE, SUPPORT, RUN, PIECE = 2, 0.8, 5, 256, 4096

# The contract's patterns. Possessive repeats and the look-behinds change no match: a run that could begin a match is entered at
# its first character only, and nothing is given back where giving back can't help; so long runs take linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WORD = r"[^\x20\x09-\x0D]"
INSTANCE = rf"(?<!{_WORD})[^\x20\x09-\x0D0-9@]*+[0-9@]{_WORD}*+"
SHAPES = {"email": r"@|.\.[A-Za-z]", "ip": r"^[^0-9]*[0-9]+[.:][0-9.:]*[0-9]", "card": r"(?:[0-9][^A-Za-z0-9]?){12}", "phone": r"(?:[0-9][^A-Za-z0-9]{0,2}){7}"}
SPAN = "struct<kind:int,start:long,end:long>"


def let(value: Column, use) -> Column:
    """``use(value)``, the value computed once for a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def located(text: Column, pattern: str) -> Column:
    """The non-overlapping matches of a pattern, leftmost first: array of (start, end, match).

    Places are summed up in runs of RUN matches and then over the runs, as an array that grows is copied at each step.
    """
    pieces = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    none = "array<struct<start:long,end:long,match:string>>"

    def places(p):
        steps = F.zip_with(F.slice(p["gaps"], 1, F.size(p["found"])), p["found"], lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match")))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(none).alias("out"))

        def step(acc, s):
            begin = acc["at"] + s["gap"]
            end = begin + F.length(s["match"])
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), s["match"].alias("match")))).alias("out"))

        in_runs = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(p["found"]) - 1) / RUN).cast("int")), lambda k: F.aggregate(F.slice(all_, k * RUN + 1, RUN), start, step))
        return F.when(F.size(p["found"]) == 0, F.array().cast(none)).otherwise(let(let(steps, in_runs), joined))

    def joined(runs):
        ends = F.aggregate(runs, F.array(F.lit(0).cast("long")), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + r["at"])))
        moved = lambda r, by: F.transform(r["out"], lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["match"].alias("match")))
        return let(ends, lambda e: F.flatten(F.zip_with(runs, F.slice(e, 1, F.size(runs)), moved)))

    return let(pieces, places)


def _luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return let(F.regexp_replace(match, "[ -]", ""), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans of a text: array of (kind as a number, start, end, hash of the match), by kind and start."""
    none = F.array().cast("array<struct<kind:int,start:long,end:long,h:long>>")
    may = {"email": F.contains(text, F.lit("@")), "ip": text.rlike("[0-9]"), "card": text.rlike("[0-9]"), "phone": F.contains(text, F.lit("+"))}

    def of(i, kind):
        kept = F.filter(located(text, PATTERNS[kind]), lambda m: _passes(kind, m["match"]))
        return F.when(may[kind], F.transform(kept, lambda m: F.struct(F.lit(i).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.xxhash64(m["match"]).alias("h")))).otherwise(none)

    return F.concat(*[of(i, kind) for i, kind in enumerate(KINDS)])


def _instances(text: Column) -> Column:
    """Words with a digit or an @: their places without the marks around them, and their patterns."""
    none = F.array().cast("array<struct<start:long,end:long,instance:string,patterns:array<string>>>")
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    bare = lambda w: F.coalesce(F.lower(F.regexp_replace(w, r"[^\p{L}]", "")), F.lit(""))
    bare_ones = lambda all_, i: F.transform(F.array(*[F.lit(k) for k in (-2, -1, 1, 2)]), lambda k: F.when(i + k >= 0, bare(F.get(all_, i + k))).otherwise(""))

    def patterns(near):
        far_l, l, r, far_r = (F.get(near, F.lit(k)) for k in range(4))
        return F.array_compact(
            F.array(
                F.when(l != "", F.concat(F.lit("L:"), l)),
                F.when((l != "") & (far_l != ""), F.concat(F.lit("LL:"), far_l, F.lit(" "), l)),
                F.when(r != "", F.concat(F.lit("R:"), r)),
                F.when((r != "") & (far_r != ""), F.concat(F.lit("RR:"), r, F.lit(" "), far_r)),
            )
        )

    def one(m, near):
        lead = F.length(F.regexp_extract(m["match"], r"^[^\p{L}0-9+@]*", 0))
        core = F.regexp_replace(F.regexp_replace(m["match"], r"^[^\p{L}0-9+@]+", ""), r"[^\p{L}0-9]++$", "")
        core = F.when(core == "", m["match"]).otherwise(core)
        begin = m["start"] + F.when(F.length(core) == F.length(m["match"]), F.lit(0)).otherwise(lead)
        return F.struct(begin.alias("start"), (begin + F.length(core)).alias("end"), core.alias("instance"), near.alias("patterns"))

    def beside(all_):
        marked = F.filter(F.transform(all_, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].rlike("[0-9@]"))
        return F.transform(marked, lambda x: let(bare_ones(all_, x["i"]), patterns))

    found = F.zip_with(located(text, INSTANCE), let(words, beside), one)
    return F.when(text.rlike("[0-9@]"), found).otherwise(none)


def _shaped(kind: Column, instance: Column) -> Column:
    return reduce(lambda c, k: c.when(kind == KINDS.index(k), instance.rlike(SHAPES[k])), KINDS, F.when(F.lit(False), F.lit(False)))


def _sums(edges: DataFrame) -> DataFrame:
    """pattern, and how much score each kind has among its instances: edges are (pattern, kind, score)."""
    return edges.groupBy("pattern").agg(*[F.sum(F.when(F.col("kind") == i, F.col("score")).otherwise(0.0)).alias(f"s{i}") for i in range(len(KINDS))])


def learned(graph: DataFrame) -> DataFrame:
    """pattern, kind, confidence of the accepted patterns. graph: distinct (pattern, instance) and the kind, null if it is no seed there."""
    seeds = graph.groupBy("pattern").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == i).cast("double").alias(f"s{i}") for i in range(len(KINDS))])
    seeds = materialize(seeds.filter(F.greatest(*[F.col(f"s{i}") for i in range(len(KINDS))]) >= SUPPORT), "pii-seeds")
    sums, accepted = seeds, None
    for k in range(ROUNDS):
        best = F.array_max(F.array(*[F.struct(F.col(f"s{i}").alias("s"), F.lit(i).alias("kind")) for i in range(len(KINDS))]))
        per = sums.withColumn("best", best).select("pattern", F.col("best.kind").alias("kind"), F.least(F.col("best.s") / (F.col("n") + 1), F.lit(1.0)).alias("confidence"))
        accepted = materialize(per.filter(F.col("confidence") >= CONFIDENCE), "pii-patterns")
        if k < ROUNDS - 1:
            open_ = graph.filter("kind is null").select("pattern", "instance")
            hits = attached(open_, accepted, "pattern").filter(_shaped(F.col("kind"), F.col("instance")))
            scored = hits.groupBy("instance").agg(F.max(F.struct(F.col("confidence").alias("score"), "kind")).alias("b")).select("instance", "b.kind", "b.score")
            more = _sums(attached(open_, materialize(scored, "pii-scores"), "instance"))
            new = more.select("pattern", *[F.col(f"s{i}").alias(f"t{i}") for i in range(len(KINDS))])
            added = [(F.col(f"s{i}") + F.coalesce(f"t{i}", F.lit(0.0))).alias(f"s{i}") for i in range(len(KINDS))]
            sums = seeds.join(new, "pattern", "left").select("pattern", "n", *added)
    return accepted


def _touched(base: Column, instances: Column) -> Column:
    """For each instance the first base span, by kind and start, that it shares a place with, or null.

    Spans of a kind lie in order and apart, and so do instances. In the order of the spans' ends and the instances' starts, an instance's place less its own number
    is how many spans end before it: the next one is the first that can touch it. So nothing is searched.
    """

    def of_kind(i):
        def found(spans):
            ends = F.transform(spans, lambda b: F.struct(b["end"].alias("at"), F.lit(-1).alias("nth")))
            starts = F.transform(instances, lambda x, k: F.struct(x["start"].alias("at"), k.alias("nth")))
            placed = F.transform(F.sort_array(F.concat(ends, starts)), lambda x, p: F.struct(x["nth"].alias("nth"), (p - x["nth"]).alias("before")))

            def touching(x):
                near = F.get(spans, x["before"])
                return F.when(near["start"] < F.get(instances, x["nth"])["end"], near)

            return F.transform(F.filter(placed, lambda x: x["nth"] >= 0), touching)

        spans = F.filter(base, lambda b: b["kind"] == i)
        none = F.transform(instances, lambda _: F.lit(None).cast("struct<kind:int,start:long,end:long,h:long>"))
        return F.when(F.exists(base, lambda b: b["kind"] == i), let(spans, found)).otherwise(none)

    kinds = F.struct(*[of_kind(i).alias(f"k{i}") for i in range(len(KINDS))])
    first = lambda all_: F.transform(instances, lambda _, k: F.coalesce(*[F.get(all_[f"k{i}"], k) for i in range(len(KINDS))]))
    return let(kinds, first)


def _discovered(marked: DataFrame, hidden: Column | None = None) -> DataFrame:
    """key columns and found: spans that accepted patterns discover, a row for each text that has any.

    hidden: a condition on the instance; seeds for which it holds aren't used, so that their rediscovery can be measured.
    """
    both = F.arrays_zip(F.col("instances").alias("i"), _touched(F.col("base"), F.col("instances")).alias("base"))
    seen = marked.filter(F.size("instances") > 0).select("doc_id", "text_key", F.explode(both).alias("x")).select("doc_id", "text_key", "x.i.*", "x.base")
    seed = F.col("base").isNotNull() if hidden is None else F.col("base").isNotNull() & ~hidden
    seen = seen.withColumn("kind", F.when(seed, F.col("base.kind")))
    # a seed is one instance with all its words
    seen = seen.withColumn("instance", F.when(seed, F.concat(F.lit("#"), F.col("base.h").cast("string"))).otherwise(F.col("instance"))).drop("base")
    seen = materialize(seen.withColumn("pattern", F.explode("patterns")).drop("patterns"), "pii-instances")
    accepted = learned(materialize(seen.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pii-graph"))
    hits = attached(seen.filter("kind is null").drop("kind"), accepted, "pattern").filter(_shaped(F.col("kind"), F.col("instance")))
    hits = hits.groupBy("doc_id", "text_key", "start", "end").agg(F.max(F.struct("confidence", "kind"))["kind"].alias("kind"))
    return materialize(hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("found")), "pii-found")


def _marked(docs: DataFrame, *more) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    given = docs.select("doc_id", text.alias("text"), *more)
    return given.select("doc_id", F.xxhash64("text").alias("text_key"), base_spans(F.col("text")).alias("base"), _instances(F.col("text")).alias("instances"))


def _plain(base: str) -> Column:
    return F.transform(base, lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"))).alias(base)


def _with_found(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Joined by doc_id and text, not by a row number: rows that agree in both have the same spans."""
    found = small_or_plain(found)
    same = rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["text_key"] == found["text_key"])
    return rows.join(found, same, "left").select(*[rows[c] for c in rows.columns], F.coalesce(found["found"], F.array().cast(f"array<{SPAN}>")).alias("found"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id; base: array of (kind, start, end); spans: the same with what the patterns discovered, by kind and start."""
    marked = materialize(_marked(docs), "pii-marked")
    rows = _with_found(marked.select("doc_id", "text_key", _plain("base")), _discovered(marked))
    return rows.select("doc_id", "base", F.sort_array(F.concat("base", "found")).alias("spans"))  # what is found touches no base span


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _earlier_max(values: Column) -> Column:
    """For each of an array's numbers, none of which is negative, the largest before it, 0 for the first; runs of RUN at a time."""
    in_runs = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int")), lambda k: F.slice(all_, k * RUN + 1, RUN))

    def carried(parts):
        tops = F.aggregate(parts, F.array(F.lit(0).cast("long")), lambda acc, r: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), F.array_max(r)))))
        own = lambda r, top: F.transform(r, lambda _, i: F.greatest(top, F.coalesce(F.array_max(F.slice(r, 1, i)), F.lit(0).cast("long"))))
        return let(tops, lambda t: F.flatten(F.zip_with(parts, F.slice(t, 1, F.size(parts)), own)))

    return let(let(values, in_runs), carried)


def _between(pieces: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text that is cut into pieces of PIECE code points."""
    first, last = F.floor(start / PIECE), F.floor((end - 1) / PIECE)
    part = lambda k: F.substring(F.get(pieces, k.cast("int")), (F.greatest(start - k * PIECE, F.lit(0)) + 1).cast("int"), (F.least(end - k * PIECE, F.lit(PIECE)) - F.greatest(start - k * PIECE, F.lit(0))).cast("int"))
    return F.when(end <= start, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(first, F.greatest(last, first)), part), ""))


def replaced(text: Column, spans: Column) -> Column:
    """A text with each stretch that spans (start, end, kind; sorted, one at least) cover replaced by the kind of its first one, in linear time."""
    name = lambda k: F.element_at(F.array(*[F.lit(f"<{x}>") for x in KINDS]), k + 1)
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}+"), F.lit(0))

    def done(cut):
        ends = F.transform(spans, lambda s: s["end"])
        steps = F.zip_with(spans, _earlier_max(ends), lambda s, at: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), at.alias("at")))
        fresh = F.filter(steps, lambda s: s["start"] >= s["at"])
        put = F.transform(fresh, lambda s: F.concat(_between(cut, s["at"], s["start"]), name(s["kind"])))
        return F.concat(F.array_join(put, ""), _between(cut, F.array_max(ends), F.length(text).cast("long")))

    return let(pieces, done)


def redact(docs: DataFrame) -> DataFrame:
    """The rows with every span of their texts replaced by ``<kind>``; null texts stay null. All columns are kept."""
    marked = materialize(_marked(docs), "pii-marked")
    spans = _with_found(marked.select("doc_id", "text_key", _plain("base")), _discovered(marked))
    order = F.transform(F.concat("base", "found"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = spans.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.sort_array(order).alias("spans")).filter(F.size("spans") > 0)
    spans = materialize(spans.dropDuplicates(["_doc", "_key"]), "pii-spans")  # rows that agree in both have the same spans
    spans = small_or_plain(spans)
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))  # names in the row can't clash
    rows = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left")
    text = F.col("row.text")
    clean = F.when(F.col("spans").isNull() | (F.size("spans") == 0), text).otherwise(replaced(text, F.col("spans")))
    return rows.select(*[clean.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
